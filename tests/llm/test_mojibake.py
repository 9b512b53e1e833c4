import pytest
from conftest import rows

from millrace.llm import mojibake as mb

SV = ["Färgen på tröjan är mörkare än på bilden – skön, men ändå lätt på sömmen. Vi mätte ärmen här.", "Måttet över kragen är 12 cm i mellanstorleken; tvätta västen i 40 grader på låg värme.", "Sök på ”väskan” eller på märket så hittar du hela serien före höstmarknaden."]
EN = ["The shade of the scarf is darker than the photo – soft, but still. It’s well worth €40 at the café.", "If the zip comes loose, sew it back with doubled thread before the autumn fair."]
LOREM = ["Storleken stämde, fast dragkedjan satt lite högt på pappa.", "Om du sitter mellan två storlekar, välj den större.", "Färgen på filten håller efter första tvätten.", "Bälten och västar från Småviken tål väder och blöta."]


@pytest.fixture(scope="module")
def models():
    """Models trained on sentences in every order: the texts under test are made of the same words, not of the same sentences."""
    def texts(lines):
        words = [w for line in lines for w in line.split()]
        return [" ".join(words[(i * step) % len(words)] for i in range(12)) + ". " + lines[step % len(lines)] for step in range(1, 400)]

    return {"sv": mb.trained(texts(SV + LOREM)), "en": mb.trained(texts(EN + ["Wash the jacket at 40 degrees and dry it flat near the pier.", "Between sizes? Take the larger one."]))}


@pytest.fixture(scope="module")
def fix(models):
    restorer = mb.Restorer(models)
    return lambda text, lang="sv": restorer.restore(text, lang)[0]


def garble(text, codec):
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251"])
@pytest.mark.parametrize("text", SV)
def test_utf8_read_as(fix, codec, text):
    if codec in ("cp1250", "cp1251"):
        try:
            text.encode().decode(codec)
        except UnicodeDecodeError:
            return
    assert fix(garble(text, codec)) == text


def test_chains_parts_and_references(fix):
    twice = garble(garble(SV[0], "cp1252"), "cp1252")
    assert fix(twice) == SV[0] and fix(garble(garble(SV[0], "latin-1"), "cp1252")) == SV[0]
    assert fix(SV[0] + "\n" + garble(SV[1], "cp437")) == SV[0] + "\n" + SV[1]
    assert fix("".join(c if c < "\x80" else f"&#{ord(c)};" for c in garble(SV[0], "cp1252"))) == SV[0]
    assert fix(garble(EN[0], "cp1252"), "en-GB") == EN[0] and fix(garble(SV[1], "cp1252"), None) == SV[1]


@pytest.mark.parametrize("codec", ["cp850", "mac_roman"])
def test_windows_text_read_as(fix, codec):
    assert fix(SV[0].encode("cp1252").decode(codec)) == SV[0]


@pytest.mark.parametrize("text", [*SV, *EN, "Matière: coton, façon Â-line, taille « très petite »", "Áo len cỡ M, Â-Ô đẹp.", "┌──┬──┐ │S │M │ └──┴──┘ √ ok", "Размер М, цвет тёмно-синий", "Μέγεθος M, μαλλί", "サイズM、ウール80%です。", "Þæð peysa úr ull, ÐÖ-merkt", "LÃ 100 % och PÃO-väv, São Brás", "¤ § ± 5 mm ° ½", "plain", "", "å", "a &#229; b", "👩‍👧 🏽"])
def test_what_is_right_stays(fix, text):
    assert fix(text) == text


def test_rows(spark, models):
    bad = garble(SV[0], "cp1252")
    docs = spark.createDataFrame([(1, bad, "sv", "c"), (1, bad, "sv", "c"), (2, SV[0], "sv", "c"), (3, None, "sv", "c"), (4, "", None, "c"), (5, "f\ufffdr", None, "c"), (6, bad * 300, "SV_se", "c")], "doc_id long, text string, lang string, restored string")
    got = rows(mb.restored(docs, "doc_id", "text", "lang", models).select("doc_id", "restored", "lost"))
    assert got == [(1, SV[0], False), (1, SV[0], False), (5, None, True), (6, SV[0] * 300, False)]
    assert mb.restored(docs.limit(0), "doc_id", "text", "lang", models).count() == 0
    assert mb.restored(docs, "doc_id", "text", "lang", {}).where("lost").count() == 1  # without models a bare compressor decides


def test_description_length_decides(models, monkeypatch):
    """With every description equally long nothing is restored; with plain sizes in place of compressed ones single-byte misreadings aren't."""
    bad = [garble(SV[0], "cp1252"), SV[1].encode("cp1252").decode("cp850")]
    for measure, want in ((lambda data: b"", bad), (lambda data: data, [SV[0], bad[1]])):
        restorer = mb.Restorer(models)
        restorer.compress = dict.fromkeys(models, measure)
        assert [restorer.restore(t, "sv")[0] for t in bad] == want
    assert [mb.Restorer(models).restore(t, "sv")[0] for t in bad] == [SV[0], SV[1]]


def test_sentences_join_to_the_text():
    text = "a; b &#195;&#165; 1.5 kr.\n\nx?! y:\n z;;"
    assert "".join(mb.sentences(text)) == text and mb.sentences("") == []


def test_models_take_undamaged_samples_up_to_their_bound(spark):
    texts = [f"{' '.join(SV[(i + k) % 3] for k in range(1 + i % 4))} Order {i * 7919}" for i in range(300)]
    docs = spark.createDataFrame([(i, t, "sv-SE") for i, t in enumerate(texts)] + [(1000 + i, garble(t, "cp1252"), "sv") for i, t in enumerate(texts[:30])] + [(9999, None, "sv"), (9998, EN[0], None)], "doc_id long, text string, lang string")
    models = mb.language_models(docs, "text", "lang", "doc_id", samples=200)
    assert list(models) == ["sv"] and models["sv"].characters <= set("åäöÅÄÖ–”") and "Ã".encode("latin-1") not in models["sv"].dictionary
    assert mb.language_models(docs, "text", "lang", "doc_id", samples=200, size=300) == {}  # too few bytes to train on
    assert mb.language_models(docs.limit(0), "text", "lang", "doc_id") == {}


def test_a_first_step_of_any_rank_is_carried_on(monkeypatch, models):
    start, last = "".join(chr(0x4E00 + 997 * i % 9000) for i in range(60)), len(mb.CODECS) - 1
    steps = {start: {c: start[: 30 + i] for i, c in enumerate(mb.CODECS)}, start[: 30 + last]: dict.fromkeys(mb.CODECS, "rätt")}
    monkeypatch.setattr(mb, "undo_utf8", lambda text, codec: steps.get(text, {}).get(codec, text))
    assert mb.Restorer(models).restore(start, "sv") == ("rätt", 2)


def test_models_come_from_all_texts(spark):
    """Every undamaged text is counted, however few samples are written and whatever keys the texts have; damaged ones aren't."""
    texts = [f"{SV[i % 3]} Nummer {i} är årets ö{i}." for i in range(400)] + ["Ärm", f"{'lång' * 30} slut"]
    docs = lambda start: spark.createDataFrame([(start + i, t, "sv") for i, t in enumerate(texts)] + [(-1, garble(SV[0], "cp1252"), "sv"), (-2, "f\ufffdr", "sv"), (-3, SV[0], "xx")], "doc_id long, text string, lang string")
    got = {(r["kind"], r["said"]): r["n"] for r in mb.counted(docs(0), "text", "lang", "doc_id").collect()}
    assert got["texts", ""] == 402 and got["character", "ö"] == 400 and got["character", "Ä"] == 1 and ("character", "Ã") not in got
    assert got["segment", "är"] == sum(t.split().count("är") for t in texts) and got["segment", "är årets"] == 400 and all(got["segment", f"årets ö{i}."] == 1 for i in range(400))
    assert got["segment", ("lång" * 16)] == 1 and got["segment", "lång" * 14] == 1
    assert mb.language_models(docs(0), "text", "lang", "doc_id", samples=50) == mb.language_models(docs(7919), "text", "lang", "doc_id", samples=50) != {}


def test_material_has_segments_as_often_as_counted():
    lines = mb._material([("färgen på", 60), ("tröja", 40)], 1000, 4000)
    assert b"".join(lines).count("färgen på ".encode("latin-1")) == 60 and b"".join(lines).count("tröja ".encode("latin-1")) == 40
    assert mb._material([("färgen", 10**9), ("på", 1)], 9, 5000) and mb._material([("ord", 10**9)], 9, 300) == [] == mb._material([], 9, 5000)
    assert sum(map(len, mb._material([(f"ord{i}", 10**6) for i in range(9999)], 50, 20_000))) <= 20_000
