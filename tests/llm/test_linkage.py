import random

import pytest
from conftest import rows

from millrace.llm import linkage as lk
from millrace.llm.listing import Parser, article_number, house, letters_apart, maker, measure, stem

KINDS = [(1, "Jackor"), (1, "Jackets"), (1, "jacka"), (1, "Jakker"), (2, "Koftor"), (2, "Strickjacken"), (3, "Byxor"), (3, "byxa"), (4, "Dry bags"), (4, "dry bag"), (5, "Bags"), (5, "bag"), (6, "Kepsar"), (6, "keps")]


def test_measures_have_canonical_units():
    assert {measure(t) for t in ("0,28 kg/m²", "280 g/m2", "tyg 280gsm")} == {"w280"}
    assert {measure(t) for t in ("1,5 L", "150 cl", "1500 ml", "1.5 litres")} == {"v1500"} and measure("180 cm") == measure("1,8 m") == "l1800"
    assert measure("5*40 cm") is None and measure("") is None


@pytest.mark.parametrize("text, kind", [("sommarjacka X", 1), ("Damen-Strickjacke", 2), ("jakke", 1), ("moss dry bag", 4), ("bag", 5), ("barnkeps", 6), ("dambyxa", 3), ("", None), ("x" * 9999, None)])
def test_kinds(text, kind):
    assert Parser(KINDS).kind(text) == kind


def test_makers_and_stems():
    assert maker("Kvarn, Askmark AB") == maker("ASKMARKKVARN") and maker(" ") is None and maker(None) is None
    assert letters_apart("abc", "abc") == 0 and letters_apart("abc", "abd") == 1 and letters_apart("", "ab") == 2
    assert stem("Mössor") == stem("mössa") and stem("Rygsække") == stem("rygsæk")


def test_a_listing():
    a = Parser(KINDS).parse("*REA* sommarjacka RUPASAKU 0,28 kg/m²", "lymning", "<p>Rapusaku är en jacka i tvättat linne. Färgen heter <b>ljusgrå</b> och måttet är 280 gsm.</p>", [None, "SE-LY-62594 22/S"])
    assert (a.code, a.prefix, a.kind, a.colour, a.measure) == ("6259422", "sely", 1, "light grey", "w280")
    assert {"rupasaku", "rapusaku", "tvattat"} <= set(a.words) and not {"sommarjacka", "jacka", "ljusgra"} & set(a.words)
    nothing = Parser(KINDS).parse(None, None, None, None)
    assert (nothing.code, nothing.kind, nothing.colour, nothing.measure, nothing.maker, nothing.words) == (None, None, None, None, None, [])


def test_article_numbers_of_any_shape():
    assert article_number(["AB-1234/5 S", "AB-1234/5 M"]) == ("12345", "ab") == article_number(["ab 1234.5"])
    assert article_number(["store-k0069360", "store-k0069361"])[0] is None and article_number(["S", None, ""])[0] is None and article_number(None) == (None, "")
    assert house("Kvarn, Askmark AB") == house("askmarkKvarn") == "as" and house("AB") is None


def test_real_titles_have_their_model_read(spark):
    """Models of any shape are told by being one maker's and shared by listings; trade words by being many makers'."""
    makers = ["Canon", "Fjällräven", "Patagonia", "Nikon", "Haglöfs", "Houdini", "Klättermusen", "Peak"]
    given = [("Canon EOS R6 camera", "Canon"), ("camera R6 Canon new waterproof", "Canon"), ("Fjällräven Keb Eco-Shell jacka", "Fjällräven"), ("Keb jacka waterproof new", "Fjällräven"), ("Patagonia Torrentshell 3L jacka", "Patagonia"), ("new Torrentshell jacka", "Patagonia"), ("Torentshell jacka", "Patagonia")]
    given += [(f"{w} waterproof jacka {'new' if i % 2 else ''}", m) for i, m in enumerate(makers) for w in (f"Item{i}x", f"Item{i}y")]
    given += [(f"{m} Z{i}{j} camera", m) for i, m in enumerate(("Nikon", "Sony", "Leica", "Pentax")) for j in range(2)]
    df = spark.createDataFrame([(str(i), t, v, None, None) for i, (t, v) in enumerate(given)], "product_id string, title string, vendor string, body string, skus array<string>")
    got = {r["product_id"]: r["model"] for r in lk.modelled(lk.numbered(lk.parsed(df, "product_id", "title", "vendor", "body", "skus", KINDS)), "product_id").collect()}
    assert [got[str(i)] for i in range(7)] == ["r6", "r6", "keb", "keb", "torrentshell", "torrentshell", "torrentshell"]


def test_a_shops_own_numbers_are_no_article_numbers(spark):
    rows_ = [(f"p{i}", f"jacka Modell{i}", f"{n} Kvarn", None, [f"{n[:2]}-1234{i}"]) for i, n in enumerate(("Askmark", "Velsjo", "Lymning", "Torfors"))]
    rows_ += [(f"q{i}", f"jacka Modell{i}", f"{n} Kvarn", None, [f"shop-1234{i}"]) for i, n in enumerate(("Askmark", "Velsjo", "Lymning", "Torfors"))]
    df = spark.createDataFrame(rows_, "product_id string, title string, vendor string, body string, skus array<string>")
    got = {r["product_id"]: r["code"] for r in lk.numbered(lk.parsed(df, "product_id", "title", "vendor", "body", "skus", KINDS)).collect()}
    assert {k for k, v in got.items() if v} == {"p0", "p1", "p2", "p3"}


def test_weights_are_learnt():
    r = random.Random(1)
    counts = {}
    for _ in range(3000):
        same = r.random() < 0.4
        pattern = "n" + "".join("=" if r.random() < (0.95 if same else 0.2) else "x" for _ in range(4)) + ("=" if r.random() < 0.9 else "n")
        counts[pattern] = counts.get(pattern, 0) + 1
    match = lk.fit(counts)
    assert match["n====="] > 0.9 and match["nxxxx="] < 0.1 and lk.fit({}) == {}


SCHEMA = "product_id string, code string, model string, kind long, colour string, measure string, maker string, sig string"


def pairs(spark, *listings):
    df = spark.createDataFrame([(*x, "c") for x in listings], SCHEMA)
    return rows(lk.item_pairs(lk.same_items(df, "product_id"), "product_id"))


BASE = (1, "black", "w280", "kmnr")


def test_pairs_by_the_exact_check(spark):
    """Within one item: other colours, measures, kinds and models contradict; what is unknown pairs only where one value is possible."""
    members = [
        ("a", "1234567", "rapusaku", *BASE), ("b", None, "rapusaku", *BASE), ("c", "1234567", None, None, None, None, None), ("d", None, "rapusaku", 1, "cream", "w280", "kmnr"), ("e", None, "rapusaku", 1, "black", "w320", "kmnr"),
        ("f", None, "rapusako", *BASE), ("g", None, "rapusaku", 2, "black", "w280", "kmnr"), ("h", None, "polakipi", *BASE), ("j", None, "rapusaku", 1, "black", None, "kmnr"), ("k", None, "rapusaku", 1, None, "w320", "kmnr"),
    ]
    df = spark.createDataFrame([(*m, "c", 1) for m in members], SCHEMA + ", item long")
    assert rows(lk.item_pairs(df, "product_id")) == [("a", "b"), ("a", "c"), ("a", "f"), ("b", "f"), ("e", "k")]


def catalog(n=40):
    """Listings of n articles of five makers, three shops each, with unknown fields here and there."""
    r, out = random.Random(3), []
    for i in range(n):
        fields = (f"model{i:02d}", i % 6 + 1, ("black", "cream", "navy")[i % 3], ("w280", "w320")[i % 2], "abcde"[i % 5] * 6)
        for shop in range(3):
            some = [None if r.random() < 0.12 and k else f for k, f in enumerate(fields)]
            out.append((f"{i:02d}-{shop}", f"{7000 + i}" if shop == 0 or r.random() < 0.3 else None, *some))
    return out


def test_the_fitted_weights_decide(spark, monkeypatch):
    """With every pair as likely as another, other models of a maker are linked."""
    items = lambda: {r["product_id"]: r["item"] for r in lk.same_items(spark.createDataFrame([(*x, "c") for x in catalog()], SCHEMA), "product_id").collect()}
    fitted = items()
    articles = {}
    for k, i in fitted.items():
        articles.setdefault(i, set()).add(k[:2])
    assert all(len(a) == 1 for a in articles.values()) and len(articles) < 60
    monkeypatch.setattr(lk, "fit", lambda counts: dict.fromkeys(counts, 1.0))
    assert items() != fitted


def test_listings_that_name_nothing_join_the_one_item_they_fit(spark):
    given = [*catalog(), ("bare", None, None, 2, "cream", "w320", "b" * 6), ("alone", None, None, None, None, None, None)]
    got = {r["product_id"]: r["item"] for r in lk.same_items(spark.createDataFrame([(*x, "c") for x in given], SCHEMA), "product_id").collect()}
    assert len(got) == len(given) and sum(i == got["alone"] for i in got.values()) == 1


def test_wide_blocks_are_compared_whole_and_empty_tables(spark, monkeypatch):
    assert pairs(spark) == []
    many = spark.createDataFrame([(f"s{i}", None, "rapusaku", 1, "black", f"w{i % 7}", f"ab{'c' * i}") for i in range(30)], SCHEMA.replace("product_id", "sig").replace(", sig string", ""))
    monkeypatch.setattr(lk, "fit", lambda counts: dict.fromkeys(counts, 1.0))
    want = {(f"s{i}", f"s{j}") for i in range(30) for j in range(30) if f"s{i}" < f"s{j}"}
    for size in (200, 7, 1):
        monkeypatch.setattr(lk, "CHUNK", size)
        assert {(r["a"], r["b"]) for r in lk.links(many).collect()} == want


def test_rows_of_one_key_count_once(spark):
    df = spark.createDataFrame([("a", "jacka Rapusaku svart", "V", None, None), ("a", "jacka Rapusaku svart", "V", None, []), (None, "x", None, None, None)], "product_id string, title string, vendor string, body string, skus array<string>")
    got = lk.modelled(lk.numbered(lk.parsed(df, "product_id", "title", "vendor", "body", "skus", KINDS)), "product_id")
    assert [(r["product_id"], r["model"], r["colour"]) for r in got.collect()] == [("a", "rapusaku", "black")]
    assert lk.parsed(df.limit(0), "product_id", "title", "vendor", "body", "skus", KINDS).count() == 0


def test_listings_with_misspelt_and_divided_models_are_paired(spark, tmp_path):
    base = [(f"{m}{i}", f"{m} jacka svart 280 gsm") for m in ("Polakipi", "Bidokava", "Rapusaku", "Samagadi") for i in range(3)]
    given = [*base, ("x", "Polakii jacka svart 280 gsm"), ("y", "Sama gadi jacka svart 280 gsm")]
    spark.createDataFrame([(k, t, "Kvarn", None, None) for k, t in given], "product_id string, title string, vendor string, body_html string, skus array<string>").write.parquet(str(tmp_path / "product_record.parquet"))
    spark.createDataFrame([("product_type", 1, "Jackor", ["jacka"])], "field_name string, canon_id long, name string, alt_names array<string>").write.parquet(str(tmp_path / "canon_value.parquet"))
    models = {r["product_id"]: r["model"] for r in lk.listing_items(spark, str(tmp_path)).collect()}
    assert models["x"] == "polakipi" and models["y"] == "samagadi"


def test_the_driver_plans_few_joins_at_once(spark):
    """Items and what is held of them are written before pairs are made: each plan reads them, and no plan holds all that led to them several times over."""
    items = lk.same_items(spark.createDataFrame([(*x, "c") for x in catalog(6)], SCHEMA), "product_id")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (items, lk.item_pairs(items, "product_id"))]
    assert [p.count("Join ") for p in plans] == [0, 1]
