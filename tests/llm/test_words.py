"""Hashes of words and windows, and what the operators make of words that a weaker hash takes for one another."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tasktide.llm.decontaminate import Decontamination
from tasktide.llm.near_dedup import near_duplicates
from tasktide.llm.packing import Packing, PartTokenizer
from tasktide.llm.words import _BASES, _PRIME, Texts, _power, _times, byte_runs, mix, runs

SCHEMA = "doc_id long, text string"


def morse(n: int) -> tuple[str, str]:
    """The Thue-Morse word of n letters and its complement."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, _PRIME, (2, 2000), dtype=np.uint64)
    a[:4], b[:4] = [0, _PRIME - 1, _PRIME - 1, 1], [7, _PRIME - 1, 1, _PRIME - 1]
    assert _times(a, b).tolist() == [int(x) * int(y) % _PRIME for x, y in zip(a, b, strict=True)]
    assert _power(300, False).tolist() == [pow(_BASES[0], i, _PRIME) for i in range(300)]
    assert set(_times(_power(300, False), _power(300, True)).tolist()) == {1}


@pytest.mark.parametrize("n", [1, 64, 1024, 100_000, 1_100_000])
def test_hash_follows_the_bytes_not_the_place(n):
    rng = np.random.default_rng(n)
    word = rng.integers(97, 123, n, dtype=np.uint8)
    other = word.copy()
    other[n // 2] ^= 1
    data = np.concatenate([word, rng.integers(0, 256, 999, dtype=np.uint8), word, other])
    starts = np.array([0, n + 999, 2 * n + 999])
    h = byte_runs(data, starts, starts + n)
    assert h[0] == h[1] != h[2]
    h = runs(mix(data.astype(np.uint64)), starts, starts + n)
    assert h[0] == h[1] != h[2]


def test_words_of_a_cancelling_sequence_differ(spark):
    for n in (64, 1024, 2048, 65536):
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in morse(n))
        assert len(set(byte_runs(np.concatenate([a, b]), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
        assert len(set(runs(np.concatenate([a, b]).astype(np.uint64) << np.uint64(50), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    x, y = morse(2048)
    docs = spark.createDataFrame([(1, f"{x} one two"), (2, f"{y} one two"), (3, x), (4, y)], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 2, 80).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    hits = Decontamination().judged(spark.createDataFrame([(4, f"{y} hello"), (5, f"{x} hello")], SCHEMA), spark.createDataFrame([("i", x)], "item_id string, text string"))
    assert {r.doc_id: r.n_hit for r in hits.collect()} == {4: 0, 5: 1}


def test_tokens_of_words_with_one_hash(spark, monkeypatch):
    """The tokenizer's own ids, even where every part has the same hash."""
    from tokenizers import Tokenizer

    from tasktide.llm import packing, words

    texts = ["one two one", morse(2048)[0], morse(2048)[1], "two, three! l'été 12 one"]
    tokenizer = Tokenizer.from_file(Packing().tokenizer)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    rows = {r.doc_id: r.ids_crc32 for r in Packing().pieces(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert rows == {i: zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for i, ids in enumerate(expected)}

    monkeypatch.setattr(words, "byte_runs", lambda data, starts, ends: np.full(len(starts), 5, np.uint64))
    small = PartTokenizer(Packing().tokenizer, 100)
    for _ in range(3):
        for _, _, batch in packing.slices(pa.array(texts)):
            ids, at = small.encode(batch)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == expected


def encoded(tokenizer, texts):
    from tasktide.llm.packing import slices

    out = []
    for _, _, batch in slices(pa.array(texts), 500):
        ids, at = tokenizer.encode(batch)
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    return out


def test_parts_are_tokenized_once_while_the_table_has_room():
    """Before, a part took over the slot of another one, which was tokenized again when it came back."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    lexicon = ["".join(x) for x in {tuple(rng.choice(list("abcdeü"), n)) for n in rng.integers(1, 30, 3000)}]
    texts = [" ".join(lexicon[i : i + 40]) for i in range(0, len(lexicon), 40)]
    tokenizer, small = PartTokenizer(Packing().tokenizer, len(lexicon)), PartTokenizer(Packing().tokenizer, 100)
    whole = Tokenizer.from_file(Packing().tokenizer)
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):
        assert encoded(tokenizer, texts) == expected == encoded(small, texts)
        assert tokenizer.n == len(lexicon)


@pytest.mark.parametrize("hashes", [1, 4])
def test_tokens_of_short_words_with_few_hashes(monkeypatch, hashes):
    from tokenizers import Tokenizer

    from tasktide.llm import packing

    monkeypatch.setattr(packing, "mix", lambda h: h & np.uint64(hashes - 1))
    texts = ["a\0 b a\0\0 aa", "one two one 12 l'été, don't", "x" * 8, "x" * 9 + " " + "x" * 16, "x" * 17 + "!" * 17, None, "", " é ÀÉ×ß "]
    whole = Tokenizer.from_file(Packing().tokenizer)
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    tokenizer = PartTokenizer(Packing().tokenizer, 20)
    for _ in range(3):
        assert encoded(tokenizer, texts) == expected


def test_tokens_of_bytes_that_are_no_utf8():
    from tokenizers import Tokenizer

    rows = [b"ab\xc3", b"\x80b", b"q \xc3 x", b"\xff\xfe z", b"\xc3\xa9\xc3", b"ok"]
    texts = Texts(np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(x) for x in rows])), np.ones(len(rows), bool))
    ids, at = PartTokenizer(Packing().tokenizer, 20).encode(texts)
    whole = Tokenizer.from_file(Packing().tokenizer)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [whole.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for x in rows]
