"""A word that a worker has met is replayed once, and forgetting words changes no tokens."""

import random

import pytest

P = pytest.importorskip("public_tokenizers")

from sheafline.llm import bpe  # noqa: E402


@pytest.fixture
def codec():
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)


def want(codec, texts):
    return [[i for w in codec.split(t or "") for i in codec.plain(w.encode())] for t in texts]


def got(codec, texts):
    ids, ends = codec.encode(texts)
    starts = [0, *ends.tolist()]
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


def test_known_words_are_not_replayed_again(codec, monkeypatch):
    asked, replay = [], codec.replay
    monkeypatch.setattr(codec, "replay", lambda words: asked.append(words) or replay(words))
    codec.encode(["one, two. three", None])
    codec.encode(["", "one. two, three."])  # the same words, otherwise next to each other
    assert asked == [[b"one", b",", b" two", b".", b" three"]]


def test_forgotten_words_are_replayed_anew(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    random.seed(2)
    for k in range(30):
        texts = [" ".join("".join(random.choices("abcé", k=random.choice((1, 1, 5)))) for _ in range(random.randint(0, 20))) for _ in range(4)] + [None, "", " \n\n x" * k]
        assert got(codec, texts) == want(codec, texts)
        assert len(codec.number) <= 40 and len(codec.met) == len(codec.number) == len(codec.ends) - 1
    assert got(codec, []) == []
