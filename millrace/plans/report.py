"""The scorecard as one HTML page. Counts are computed from the card, never stated by hand."""

from __future__ import annotations

from html import escape

from millrace.operators.scoring import ABSENT, STRATA

_STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse;width:100%}th,td{padding:.3rem .5rem;border-bottom:1px solid #ccc;text-align:left}td{font-variant-numeric:tabular-nums}.pair{display:grid;grid-template-columns:1fr 1fr;gap:1rem}"


def number(value: float | None) -> str:
    return "—" if value is None else f"{value:.3f}"


def _table(head: list[str], body: list[list[str]]) -> str:
    def line(cells: list[str], tag: str) -> str:
        return "<tr>" + "".join(f"<{tag}>{escape(str(c), quote=True)}</{tag}>" for c in cells) + "</tr>"

    return f"<table><thead>{line(head, 'th')}</thead><tbody>{''.join(line(r, 'td') for r in body)}</tbody></table>"


def _examples(card: dict) -> str:
    out = []
    for e in card.get("examples") or []:
        columns = [_table([title, "grade"], [[r.get("title") or "—", r.get("grade", 0)] for r in e.get(side) or []] or [["no results", ""]]) for title, side in (("shop's own search", "native"), ("lexicon search", "mine"))]
        out.append(f"<h2>{escape(e['query'])}</h2><div class=pair>{''.join(f'<div>{c}</div>' for c in columns)}</div>")
    return "".join(out)


def page(card: dict) -> str:
    """HTML of a scorecard; systems, strata and queries that it lacks are shown as missing, unknown strata left out."""
    systems = card["systems"]
    labels = [s.get("label") or name for name, s in systems.items()]
    answerable = len({r["id"] for r in card.get("per_query") or [] if r["stratum"] != ABSENT})
    known = {s for one in systems.values() for s in one.get("by_stratum", {})}
    summary = _table(["measure", *labels], [
        [f"nDCG@{card.get('k', 10)}, {answerable} answerable queries", *(number(s["answerable_ndcg"]) for s in systems.values())],
        [f"P@{card.get('k', 10)}", *(number(s["precision"]) for s in systems.values())],
        ["results on absent queries", *(s["absent_returned"] for s in systems.values())],
    ])
    strata = _table(["stratum", *labels], [[s, *(number(one.get("by_stratum", {}).get(s, 0.0)) for one in systems.values())] for s in STRATA if s in known])
    cells: dict[str, dict] = {}
    for r in card.get("per_query") or []:
        cells.setdefault(r["id"], {"": r})[r["system"]] = r["ndcg"]
    queries = _table(["id", "query", "stratum", *labels], [[i, c[""]["query"], c[""]["stratum"], *(number(c.get(s)) for s in systems)] for i, c in cells.items()])
    held = card.get("holdout")
    holdout = ""
    if held:
        holdout = f"<h2>Held-out queries {escape(str(held['queries'].get('id', '')))}</h2>" + _table(["system", "nDCG, answerable", "on absent queries"], [[s.get("label") or n, number(s["answerable_ndcg"]), s["absent_returned"]] for n, s in held["systems"].items()])
    snapshot, overlap = card.get("snapshot") or {}, card.get("overlap") or {}
    about = f"Snapshot {snapshot.get('run_id', '?')}: {snapshot.get('count', '?')} products. Of the shop's own results {overlap.get('mapped', 0)} are in it, {overlap.get('unmapped', 0)} not."
    title = escape(f"Search quality: {card.get('display_name') or card.get('store') or 'a shop'}")
    return f"<!DOCTYPE html><html lang=en><meta charset=utf-8><title>{title}</title><style>{_STYLE}</style><h1>{title}</h1><p>{escape(about)}</p>{summary}<h2>By kind of query</h2>{strata}<h2>By query</h2>{queries}{_examples(card)}{holdout}</html>\n"
