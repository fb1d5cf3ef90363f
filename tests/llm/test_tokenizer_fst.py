import random
from pathlib import Path

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from sentencepiece import sentencepiece_model_pb2 as pb  # noqa: E402

from logstrata.llm import tokenizer_fst as fst  # noqa: E402
from logstrata.llm.registry import TOKENIZERS  # noqa: E402

MODEL = Path(TOKENIZERS, "piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "a   ", "▁▁ x", "▁", "　日本語", "ﬁ x  \n\t", "a" * 300, " " * 45 + "b", "\U0001f600" * 3, "Aé\x00b", "aaaaabbbbb    ccccc" * 30, "x y\xa0z", "<unk><s></s><0x41>"]


def texts(seed=1, n=1500):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices("ab  ▁e\nthin日é \U0001f600x", k=rng.randrange(1, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    if not MODEL.exists():
        pytest.skip("no vocabulary files")
    return MODEL.read_bytes()


def test_bpe_equals_the_library(model):
    mine, theirs = fst.SentencePieceFst(model, cache_size=500), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in texts():
        ids = theirs.encode(text)
        assert mine.encode(text) == ids
        assert mine.decode(ids) == theirs.decode(ids)


def test_segments_with_one_hash_are_told_apart(model, monkeypatch):
    monkeypatch.setattr(fst, "BASE", 1)  # the hash is a sum of the characters
    mine, theirs = fst.SentencePieceFst(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    values = ["listen silent enlist", "tinsel listen", "silent", "", "ad bc ad", "é\U0001f600", *texts(4, 300)]
    assert mine.encode_all(values) == [theirs.encode(t) for t in values]
    assert mine.encode_all(values[::-1]) == [theirs.encode(t) for t in values[::-1]]


def test_words_are_searched_once_whatever_stands_beside_them(model, monkeypatch):
    searched = []

    class Counted(fst.Lattice):
        def __init__(self, *given):
            super().__init__(*given)
            searched.append(self.nodes)

    monkeypatch.setattr(fst, "Lattice", Counted)
    mine, theirs = fst.SentencePieceFst(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    words, marks = ["gannet", "fulmar", "guillemot", "cormorant"], [".", ",", "!\n", "***", "\n\n", "&&&", "7", "?"]
    text = " ".join(w + m + v for w in words for m in marks for v in words)
    assert mine.encode(text) == theirs.encode(text)
    assert sum(searched) < 200 < len(text)


def unigram(byte_fallback):
    """A small unigram model, put together by hand."""
    rng = random.Random(7)
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = byte_fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=piece, score=0, type=kind)
    if byte_fallback:
        for b in range(256):
            proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    pieces = {"".join(rng.choices("▁abethin", k=rng.randrange(1, 4))) for _ in range(120)} | set("▁abethin")
    for piece in sorted(pieces):
        proto.pieces.add(piece=piece, score=-rng.uniform(1, 9), type=1)
    return proto.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_equals_the_library(byte_fallback):
    raw = unigram(byte_fallback)
    mine, theirs = fst.SentencePieceFst(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in texts(2, 800):
        if "▁" in text:
            continue
        assert mine.encode(text) == theirs.encode(text), text


def test_unsupported_models_fail():
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 3
    with pytest.raises(ValueError):
        fst.SentencePieceFst(proto.SerializeToString())
    for scores in ([-5, -5, -2, -1],):  # a whole that is merged before its part
        with pytest.raises(ValueError, match="order of merges"):
            fst.Pieces({p: i for i, p in enumerate(("a", "b", "ab", "aba"))}, scores, merges=True)


def test_rows(spark, model):
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    values = [*texts(3, 50), None, "long text " * 30_000, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(values)], "doc_id long, text string, ids string")
    found = fst.encode_decode(df, model, decoded=True).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == list(range(len(values)))
    for t, r in zip(values, found, strict=True):
        if t is None:
            assert (r.ids, r.n_ids, r.round_trip, r.decoded_text) == (None, 0, True, None)
        else:
            assert list(r.ids) == theirs.encode(t)
            assert (r.n_ids, r.decoded_text) == (len(r.ids), theirs.decode(theirs.encode(t)))
            assert r.round_trip == (r.decoded_text == t)
    assert fst.encode_decode(df.limit(0), model).count() == 0


def merged(text, score):
    """Merging as it is defined: the best score, then the leftmost, until nothing merges."""
    parts = list(text)
    while True:
        found = [(-score[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in score]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_shortest_paths_of_random_vocabularies():
    """Against merging, and against all ways to spell a text; with pieces that merging never gives and
    characters that are in pieces only."""
    import itertools
    from collections import Counter

    tested = Counter()
    for seed in range(150):
        rng, ties = random.Random(seed), 1 + 2 * (seed % 2)
        names = rng.sample("abc", 2)  # one character is in pieces only
        for _ in range(rng.randrange(1, 20)):
            names.append(rng.choice([*names, *"abc"]) + rng.choice([*names, *"abc"]))
        names = list(dict.fromkeys(n for n in names if len(n) < 7))
        score = {p: -float(i // ties) for i, p in enumerate(names)}
        id_of, scores = {p: i for i, p in enumerate(names)}, [score[p] for p in names]
        texts = ["".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(30)]
        for merges in (True, False):
            try:
                pieces = fst.Pieces(id_of, scores, merges=merges)
            except ValueError:
                continue  # refused
            tested[merges, ties] += 1

            def weight(before, piece, pieces=pieces, merges=merges):
                if not merges:
                    return fst.np.where(pieces.ids[piece] >= 0, -pieces.score[piece], 10.0).astype("f4")
                inner = before >= 0
                out = fst.np.zeros(piece.size, "f4")
                out[inner] = fst.np.where(pieces.stay_apart(before[inner], piece[inner]), 0, fst.np.inf)
                return out

            _, ends, stops = fst.Lattice(pieces, texts).paths(weight)
            for text, a, b in zip(texts, stops, stops[1:], strict=False):
                got = [text[i:j] for i, j in itertools.pairwise([0, *ends[a:b].tolist()])]
                if merges:
                    assert got == merged(text, score), (seed, text)
                else:
                    cost = lambda parts, score=score: sum(-score[p] if p in score else 10 if len(p) == 1 else 1e9 for p in parts)
                    every = ([text[i:j] for i, j in itertools.pairwise([0, *cuts, len(text)])] for n in range(len(text)) for cuts in itertools.combinations(range(1, len(text)), n))
                    assert cost(got) == min(map(cost, every)), (seed, text)
    assert len(tested) == 4 and min(tested.values()) > 30


def test_hash_tables():
    rng = fst.np.random.default_rng(5)
    keys = fst.np.unique(rng.integers(0, 1 << 40, 5000))
    table = fst.Table(keys, fst.np.arange(keys.size))
    assert (table.get(keys) == fst.np.arange(keys.size)).all()
    assert (table.get(keys + 1)[~fst.np.isin(keys + 1, keys)] == -1).all()
    assert fst.Table(keys[:0], keys[:0]).get(keys).max() == -1
