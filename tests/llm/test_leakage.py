import random

from conftest import rows
from pyspark.sql import functions as F

from millrace.llm import leakage as lk

ITEM = [f"word{i}" for i in range(40)]


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def brute(item, text, span=20, most=3):
    """Whether a stretch of the text is within the edits of a stretch of ``span`` words of the item."""
    for s in range(len(item) - span + 1):
        for low in range(len(text) + 1):
            for size in range(span - most, span + most + 1):
                if edits(item[s : s + span], text[low : low + size]) <= most:
                    return True
    return False


def test_words():
    assert lk.words("<p>Ä&amp;b</p> _Hej_-DÅ, l\u00adångt re\u0301s\u200bume <b>ha</b>lv [länk](http://x/y) ﬁn") == ["a", "b", "hej", "da", "langt", "resume", "halv", "lank", "fin"]
    assert lk.words(None) == lk.words("") == lk.words("!? —") == []


def test_gram_size_loses_nothing():
    assert lk.gram_size(20, 3) == 5 and lk.gram_size(20, 0) == 20 and lk.gram_size(5, 4) == 1


def test_bit_parallel_matching_is_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(n)] for n in (6, r.randint(0, 12)))
        want = any(edits(a, b[i:j]) <= 2 for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert (lk.matches(a, b, 2) is not None) == want


def test_against_brute_force():
    r = random.Random(6)
    scanner = lk.Scanner([" ".join(ITEM)])
    for _ in range(40):
        at, size = r.randint(0, 18), r.choice([17, 19, 20, 21, 22])
        part = list(ITEM[at : at + size])
        for _ in range(r.randint(0, 5)):
            i = r.randrange(len(part))
            part[i : i + 1] = r.choice([["other"], [], [part[i], "more"]])
        text = ["x"] * 5 + part + ["y"] * 5
        assert bool(scanner.leaked([" ".join(text)])) == brute(ITEM, text), text


def test_spelling_does_not_matter_and_short_passages_do():
    scanner = lk.Scanner([" ".join(ITEM), "too short", None])
    whole = " ".join(ITEM[5:25])
    texts = [whole.upper().replace(" ", ",  <b>"), " ".join(ITEM[5:20]), "too short", None, " ".join(ITEM[5:24]) + " end", "x " * 50_000 + whole, "", whole[:60], whole[60:]]
    assert scanner.leaked(texts) == [(0, 0), (4, 0), (5, 0)]  # the fifth has nineteen words and one changed
    assert [i for i, t in enumerate(texts) if scanner.leaked([t])] == [0, 4, 5]
    assert lk.Scanner([]).leaked(texts) == [] and scanner.leaked([]) == []


def test_placed_words_are_the_words(spark):
    texts = ["<p>Ä&amp;b</p> _Hej_-DÅ, l\u00adångt re\u0301s\u200bume <b>ha</b>lv [länk](http://x/y) ﬁn", "a&#229;b &eacute;t", "", "x<!-- no -->y"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    for t in texts:
        placed = lk.placed_words(t)
        assert [w for w, _, _ in placed] == lk.words(t)
        assert all(0 <= a < b <= len(t) for _, a, b in placed)


def test_passages_are_cut_whole_and_nothing_else():
    r = random.Random(8)
    scanner = lk.Scanner([" ".join(ITEM), " ".join(f"other{i}" for i in range(25))])
    for _ in range(30):
        at, size = r.randint(0, 15), r.randint(20, 25)
        part = list(ITEM[at : at + size])
        part[r.randrange(3, size - 3)] = "changed"
        before, after = [f"b{i}" for i in range(r.randint(0, 9))], [f"a{i}" for i in range(r.randint(0, 9))]
        kept = scanner.without(" ".join([*before, *part, *after]))
        assert kept.split() == before + after
    assert scanner.without("nothing here") == "nothing here" and scanner.passages(None) == []
    twice = " ".join(ITEM) + " between " + " ".join(f"<i>Other{i}</i>" for i in range(25))
    assert lk.words(scanner.without(twice)) == ["between"] and scanner.leaked([scanner.without(twice)]) == []


def test_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(ITEM), "c"), (1, " ".join(ITEM), "c"), (2, None, "c"), (3, "", "c"), (4, " ".join(ITEM[::-1]), "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(ITEM), "x"), (8, " ".join(ITEM[:30]), "x"), (9, None, "x")], "item_id int, text string, doc_id string")
    want = [(1, 7), (1, 8)]
    for block in (10, 1):  # one block, and more items than one broadcast takes
        assert rows(lk.leaks(docs, "doc_id", "text", items, "item_id", "text", block=block)) == want
        assert rows(lk.without_leaks(docs, "text", items, "text", block=block)) == [(1, "\n", "c"), (1, "\n", "c"), (2, None, "c"), (3, "", "c"), (4, " ".join(ITEM[::-1]), "c")]
        assert [r[0] for r in rows(lk.without_leaks(docs, "text", items, "text", drop=True, block=block))] == [2, 3, 4]
    assert lk.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert lk.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    keyed = docs.select(F.col("doc_id").cast("decimal(10,0)").alias("doc_id"), "text")
    assert [r[1] for r in rows(lk.leaks(keyed, "doc_id", "text", items.withColumn("item_id", F.col("item_id") / 2), "item_id", "text"))] == [3.5, 4.0]


def test_every_twentieth_document_against_all_items_by_brute_force(spark):
    """Recall 1.0: the n-gram filter loses no passage that word-by-word comparison with every item finds."""
    folder = "/root/testdata/sf0.01"
    items = {r["item_id"]: lk.words(r["text"]) for r in spark.read.parquet(f"{folder}/eval_item.parquet").collect()}
    documents = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 20 = 0")
    found = set(map(tuple, lk.leaks(documents, "doc_id", "text", spark.read.parquet(f"{folder}/eval_item.parquet"), "item_id", "text").collect()))
    want = set()
    for r in documents.collect():
        tokens = lk.words(r["text"])
        for item, w in items.items():
            if len(set(tokens) & set(w)) >= 12 and any(lk.matches(w[s : s + 20], tokens, 3) is not None for s in range(len(w) - 19)):
                want.add((r["doc_id"], item))
    assert found == want
