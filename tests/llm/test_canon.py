import random

from conftest import rows

from millrace.llm import canon
from millrace.llm.edits import osa

NAMES = [("vendor", 1, "Askmark Kvarn"), ("vendor", 2, "Stengarn & Vasslöv"), ("vendor", 3, "Quelrask"), ("vendor", 4, "Sälgfors Studio"), ("vendor", 5, "Velsjö"), ("vendor", 6, "Velsjö Studio"), ("product_type", 10, "Förkläden"), ("product_type", 10, "Aprons"), ("product_type", 11, "Byxor"), ("product_type", 11, "Trousers"), ("product_type", 12, "Mössor")]
CASES = {
    "  ASKMARK   kvarn ": 1, "Kvarn, Askmark": 1, "AskmarkKvarn": 1, "Askmak Kvaarn": 1, "Ask-mark Kvarn": 1, "Brand: Askmark Kvarn AB": 1, "Stengarn och Vassloev": 2, "StengarnochVasslöv": 2, "Stengarn and Vasslöv®": 2,
    "Quelrsk": 3, "uQelrask": 3, "Qualresk": -1, "Saelgfors Studio GmbH": 4, "Velsjö": 5, "Velsjö Studio (official)": 6, "Askmark Studio": -1, "Askmark": -1, "Lymmark Fabrik": -1, "AB": -1, "®": -1, "&": -1, "x" * 5000: -1, "Velsjo\u0308": 5,
}
TYPES = {"Dam > Förkläden": 10, "Förkldäen": 10, "aprons.": 10, "Byxor | Trousers": 11, "Rea – Byxr": 11, "Byxor 2026": 11, "Byxor | Mössor": -1, "Gitarrsträngar": -1, "Msösor (dam)": 12}


def found(spark, field, values):
    df = spark.createDataFrame([(field, v, "c") for v in [*values, None, *list(values)[:2]]], "field string, value string, canon_id string")
    reference = spark.createDataFrame([(*n, "c") for n in NAMES], "field string, canon_id long, name string, value string")
    return {r["value"]: r["canon_id"] for r in canon.canonical(df, reference).collect()}


def test_vendors(spark):
    assert found(spark, "vendor", CASES) == CASES


def test_types(spark):
    """Shop sections are known by standing beside many types."""
    others = {s.format(n): i for f, i, n in NAMES if f == "product_type" for s in ("Dam > {}", "Rea – {}", "{} 2026")}
    assert found(spark, "product_type", TYPES | others) == TYPES | others


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "field string, value string")
    some = spark.createDataFrame([("vendor", "x")], "field string, value string")
    reference = spark.createDataFrame(NAMES, "field string, canon_id long, name string")
    assert canon.canonical(empty, reference).count() == 0
    assert rows(canon.canonical(some, reference.limit(0))) == [("vendor", "x", -1, 0.0)]


def test_equally_good_entries_mean_neither(spark):
    reference = spark.createDataFrame([("f", 1, "abcdex"), ("f", 2, "abcdey")], "field string, canon_id long, name string")
    values = spark.createDataFrame([("f", "abcdez"), ("f", "abcdex")], "field string, value string")
    assert [r[1:3] for r in rows(canon.canonical(values, reference))] == [("abcdex", 1), ("abcdez", -1)]


def test_repair_finds_every_pair_within_its_budget(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(2, 9)))
    left, right = sorted({word() for _ in range(80)}), sorted({word() for _ in range(60)})
    frame = lambda ws: spark.createDataFrame([("f", w) for w in ws], "field string, token string")
    budget = lambda a, b: 0 if min(len(a), len(b)) < 3 else 1 if min(len(a), len(b)) < 6 else 2
    got = {(x[1], x[2]) for x in rows(canon.repaired(frame(left), frame(right)))}
    want = {(a, b) for a in left for b in right if osa(a, b) <= budget(a, b)}
    assert want == got


def test_weights_decide(spark, monkeypatch):
    """A word beside many entries weighs little and one of few much; with equal weights the results differ."""
    values = [f"{n} {w}" for _, _, n in NAMES[:6] for w in ("Sportswear", "trading")] + ["Quelrask Nosmark", "Vasmark Studio"]
    want = {v: next(i for _, i, n in sorted(NAMES[:6], key=lambda x: -len(x[2])) if v.startswith(n)) for v in values[:-2]} | dict.fromkeys(values[-2:], -1)
    assert found(spark, "vendor", values) == want
    monkeypatch.setattr(canon.F, "log", lambda x: canon.F.lit(1.0) + 0.0 * x)
    assert found(spark, "vendor", values) != want


def test_osa():
    assert [osa(*p) for p in (("", ""), ("ab", "ba"), ("abc", ""), ("kitten", "sitting"), ("ca", "abc"))] == [0, 1, 3, 3, 3]
