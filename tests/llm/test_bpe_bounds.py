import random

import public_tokenizers as P
from tokenizers import Tokenizer

from wavelake.llm import bpe as B

PATH = P.path("byte_bpe_50k.json")


def test_one_long_word_equals_the_library():
    lib, bpe, rng = Tokenizer.from_file(PATH), B.TrieBPE(PATH), random.Random(3)
    for letters in ("ab", "thequickbrownfoxé", "日本語のかな"):
        word = "".join(rng.choice(letters) for _ in range(150_000))
        ids = lib.encode(word, add_special_tokens=False).ids
        assert bpe.encode(word) == ids and bpe.decode(ids) == word
        assert len(bpe.last) <= B.MOST_NODES + len(word.encode()) + 1


def test_long_texts_are_cut_step_by_step(monkeypatch):
    monkeypatch.setattr(B, "PART_CHARS", 500)
    monkeypatch.setattr(B, "STEP", 7)
    lib, bpe, rng = Tokenizer.from_file(PATH), B.TrieBPE(PATH), random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice(["the", " cat", "  ", "\n", "'ll", " 12", "é", "<|endoftext|>", "!?", "\t "]) for _ in range(rng.randrange(1, 900)))
        assert bpe.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_kept_words_and_nodes_are_bounded(monkeypatch):
    monkeypatch.setattr(B, "MOST_NODES", 300)
    monkeypatch.setattr(B, "MOST_WORDS", 50)
    bpe, rng = B.TrieBPE(PATH), random.Random(5)
    fresh = B.TrieBPE(PATH)
    for _ in range(200):
        text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(20))
        ids = bpe.encode(text)
        fresh.words.clear()
        fresh.elder.clear()
        assert ids == fresh.encode(text)
        assert len(bpe.words) <= 50 + 40 and len(bpe.elder) <= 50 + 40 and len(bpe.last) <= 300 + 200


def test_words_are_computed_by_depth(monkeypatch):
    """Words up to LEVEL_BYTES go as arrays, in blocks and with few slots for pairs; the others one after another."""
    monkeypatch.setattr(B, "LEVEL_WORDS", 50)
    monkeypatch.setattr(B, "PAIR_SLOTS", 64)
    lib, bpe, rng = Tokenizer.from_file(PATH), B.TrieBPE(PATH), random.Random(9)
    alone = []
    one = bpe._follow
    monkeypatch.setattr(bpe, "_follow", lambda w: alone.append(w) or one(w))
    letters = ["e", "t", "a", "th", "ing", "é", "ñ", "日", "\x00", "0", "_", "ß"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    for at in range(0, len(words), 400):
        texts = [" ".join(words[k : k + 10]) for k in range(at, at + 400, 10)]
        assert [list(memoryview(x).cast("i")) for x in bpe.encode_all(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert alone and min(map(len, alone)) > B.LEVEL_BYTES


def test_idle_workers_hold_one_generation(monkeypatch):
    monkeypatch.setattr(B, "MOST_WORDS", 20)
    bpe = B.TrieBPE(PATH)
    for k in range(10):
        bpe.encode(" ".join(f"word{i} and" for i in range(10 * k, 10 * k + 10)))
    assert bpe.elder
    bpe.rest()
    assert not bpe.elder and bpe.words and len(bpe.words) <= 20 + 40
