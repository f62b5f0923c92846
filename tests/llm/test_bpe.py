import random

import pytest

from millrace.llm import bpe

from .cases import TEXTS, documents, empty

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")


def test_against_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = bpe.model(PATH)
    rng = random.Random(2)
    alphabet = "aeinrst  \n▁éß日本𝒳\t01.,AB\x00thion"
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids)
        n, written, decoded = model.digest(t)
        assert (n, written, decoded) == (len(ids), " ".join(map(str, ids)), library.decode(ids))


def test_any_ids_decode_as_in_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32000))) for _ in range(rng.randint(0, 8))]
        assert bpe.model(PATH).decode(ids) == library.decode(ids)


def test_compatible_pairs_are_those_that_merging_leaves():
    model = bpe.model(PATH)
    rng = random.Random(6)
    known = list(model.rank)
    for _ in range(5000):
        a, b = rng.choice(known), rng.choice(known)
        assert model._remerge(a, b) == (model.merge(model.pieces[a] + model.pieces[b]) == [a, b])


def test_cases(spark):
    out = bpe.add_counts(documents(spark), PATH)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out.collect())
    assert bpe.digests(documents(spark), PATH).count() == 10
    assert bpe.encode(documents(spark), PATH).filter("doc_id = 3").first()["decoded"] == ""
    assert bpe.digests(empty(spark), PATH).count() == 0
