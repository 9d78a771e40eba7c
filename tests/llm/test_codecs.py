"""The two vocabulary operators against their libraries."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from dealscope.llm import sentencepiece_codec, token_counts  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
PAIRS = public_tokenizers.path("byte_bpe_50k.json")


def mixtures(alphabet, n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    found = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    odd = ["", " ", "  ", "a", "<s>", "<0x0A>", "<|endoftext|>", "x<|endoftext|>!! y", "\x00\x01", "x" * 3000, " " * 400, "a▁b"]
    return found + odd + mixtures("ab e  the\n\tÉ你▁<>0x…\U0001F600'srdlv!\x1c\x85\xa0　½", 500)


def test_pieces_equal_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentencepiece_codec.Codec(PIECES)
    flat, sizes = own.encode(texts)
    at = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        ids = flat[at : at + size].tolist()
        at += size
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)


def test_remembered_words_do_not_change_ids(texts, monkeypatch):
    own, again = sentencepiece_codec.Codec(PIECES), sentencepiece_codec.Codec(PIECES)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 10)
    whole, _ = own.encode(texts)
    parts = [again.encode(texts[i : i + 7])[0].tolist() for i in range(0, len(texts), 7)]
    assert whole.tolist() == [x for p in parts for x in p]


def test_counts_equal_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PAIRS)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(PAIRS).count(texts) == want


def test_every_prefix_equals_the_library(texts):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PAIRS), token_counts.Counter(PAIRS)
    for text in [t[:250] for t in texts[-120:]] + ["don't we'll they're  <|endoftext|>  <|endo", "a  b \n\n c"]:
        prefixes = [text[:p] for p in range(len(text) + 1)]
        want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert own.prefix_counts(text).tolist() == want


def test_budget_is_the_longest_prefix(documents):
    text = "The quick brown fox, isn't it?  Jumps!\n\nÉté " * 5
    row = token_counts.truncated(documents([(1, text), (2, None), (3, "")]), PAIRS, 12).collect()
    cut = {r["doc_id"]: r["truncated"] for r in row}
    own = token_counts.Counter(PAIRS)
    assert own.count([cut[1]])[0] <= 12 < own.prefix_counts(text)[len(cut[1]) + 1 :].min()
    assert cut[2] is None and cut[3] == ""


def test_odd_rows(odd, spark):
    encoded = sentencepiece_codec.encode(odd, PIECES, decoded=True).collect()
    assert len(encoded) == odd.count()
    for r in encoded:
        assert (r["token_ids"] is None) == (r["text"] is None) and r["decoded"] == r["text"]
        assert r["words"] == "x"
    counted = token_counts.token_counts(odd, PAIRS).collect()
    assert sorted(r["n_tokens"] for r in counted)[:3] == [0, 0, 0] and len(counted) == odd.count()
    empty = odd.where("false")
    assert sentencepiece_codec.encode(empty, PIECES).count() == token_counts.token_counts(empty, PAIRS).count() == 0


def test_decode_of_encoded(odd):
    pairs = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECES), PIECES).collect()
    assert all(r["decoded"] == r["text"] for r in pairs)
