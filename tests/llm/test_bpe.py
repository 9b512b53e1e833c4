import base64
import random

import pytest
from conftest import rows

from millrace.llm import bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Encoder(bpe.TokenAutomaton(bpe.read_ranks(path))), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_public_encoder(pair):
    own, theirs = pair
    r = random.Random(2)
    texts = ["", " ", "Hello  world", "<|endoftext|>", "å" * 50, "naïve 👩‍👧 'll I'LL 'Ve", "\r\n\t x\u00a0y\u200b", "ſtraße ＡＢ", "a" * 20_000, " " * 5000, "-=" * 3000, "\x00\x7f", "a\n\nb c\n d \ne   f ", " a", "a ", "x \u2003y\x1cz \x1c"]
    texts += ["".join(r.choice("abcdefghij åäö,.'\n01239ßéД水") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        assert own(t) == theirs.encode_ordinary(t)
        assert own.automaton.decode(own(t)) == t


def test_small_automata_match_repeated_merging():
    """Against BPE done by its definition, for random merge lists."""
    r = random.Random(4)
    for _ in range(60):
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 3 + r.randint(0, 12):
            new = r.choice(tokens) + r.choice(tokens)
            if new not in tokens:
                tokens.append(new)
        try:
            automaton = bpe.TokenAutomaton(tokens)
        except ValueError:
            continue  # a list that no BPE training makes: a token that earlier merges never leave in two parts
        ids = {t: i for i, t in enumerate(tokens)}
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            parts = [word[i : i + 1] for i in range(len(word))]
            while True:
                found = min(((ids[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ids), default=None)
                if found is None:
                    break
                parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
            assert automaton.encode(word) == [ids[p] for p in parts], (tokens, word)


def test_memory_is_bounded(pair):
    encode = bpe.Encoder(pair[0].automaton, remember=10)
    for i in range(200):
        assert encode(f"word{i} x") == pair[1].encode_ordinary(f"word{i} x")
    assert max(len(encode.words), len(encode.words.old), len(encode.pieces), len(encode.pieces.old)) <= 10


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", "clash"), (2, None, ""), (3, "", ""), (1, "a b", "")], "doc_id long, text string, ids string")
    got = rows(bpe.token_ids(df, "doc_id", "text", public.path("byte_bpe_50k.tiktoken")))
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert bpe.token_ids(df.limit(0), "doc_id", "text", public.path("byte_bpe_50k.tiktoken")).count() == 0


def test_ranks_must_be_whole(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "v"))
