import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from authloom.llm import bpe, pieces, token_files
from authloom.llm.store import Store
from tests.llm.helpers import documents, words

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcst'' rRvVlLmMd \t\n123٣½!?.-—éé€　中ΣΑİß\U0001f389\x1c\x85​"
TEXTS = [None, "", " ", "Don't stop, I'LL we've 12 345!", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ é", "!" * 300,
         "x" * 5000, "ab " * 3000, "aaaa aaaaa aaaaaa", "\n\n  \n a  b\t\tc  "]


@pytest.fixture(scope="module")
def coders():
    return [(bpe.WordBpe(WORD_FILE), Tokenizer.from_file(WORD_FILE)), (token_files.ByteBpe(BYTE_FILE), Tokenizer.from_file(BYTE_FILE))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=30), st.text(max_size=15)), max_size=5))
def test_any_text(coders, texts):
    for own, library in coders:
        for ids, t in zip(own.encode(texts), texts, strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_every_character(coders):
    """Beside letters, blanks and signs, where the classes of characters show (planes 4 to 13 and 15 on hold none)."""
    every = [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xE1000), 0x50000, 0xF0000, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    for own, library in coders:
        for lo in range(0, len(every), 100_000):
            texts = [f"a{c}a !{c} {c}" for c in every[lo:lo + 100_000]]
            want = library.encode_batch_fast(texts, add_special_tokens=False)
            wrong = [t for t, x, y in zip(texts, own.encode(texts), want, strict=True) if x.tolist() != y.ids]
            assert not wrong, wrong[:5]


def test_regular_words_are_told_apart(coders):
    """Thue-Morse words, for which sums of powers are equal; and pieces whose first hashes are equal."""
    letters = lambda n, swap: "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))
    texts = [letters(n, swap) for n in (1024, 2048, 4096) for swap in (0, 1)]
    for own, library in coders:
        for ids, t in zip(own.encode(texts), texts, strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_pieces_with_equal_first_hashes(coders, monkeypatch):
    """Whatever the first hash misses, the second one tells, within a slice and against the table."""
    full = pieces.piece_hashes
    monkeypatch.setattr(pieces, "piece_hashes", lambda *a: (full(*a)[0] % np.uint64(7), full(*a)[1]))
    texts = [t or "" for t in TEXTS] + ["one two three four five six seven eight nine ten", "ten nine eight one"]
    fresh = [type(own)(path) for (own, _), path in zip(coders, (WORD_FILE, BYTE_FILE), strict=True)]
    for own, (_, library) in zip(fresh, coders, strict=True):
        for part in (texts, texts[::-1]):
            for ids, t in zip(own.encode(part), part, strict=True):
                assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_a_small_piece_table_changes_nothing(coders):
    own, library = bpe.WordBpe(WORD_FILE), coders[0][1]
    own.table.most = 5
    for _ in range(3):
        for ids, t in zip(own.encode([t or "" for t in TEXTS]), TEXTS, strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_overlapping_pairs():
    index = bpe.PairIndex({s: k for k, s in enumerate([*bpe.byte_symbols(), "aa", "aaa", "aab"])},
                          ["a a", ["aa", "a"], ["aa", "b"]])
    n, ids = index.encode([b"aaaa", b"", b"aaaaa", b"aab", b"a"])
    aa = 256
    assert n.tolist() == [2, 0, 2, 1, 1] and ids.tolist() == [aa, aa, aa, aa + 1, aa + 2, ids[-1]]


def test_encoded_documents(spark, coders):
    texts = [*enumerate(TEXTS), (None, "no id"), (3, "again")]
    library = coders[0][1]
    rows = bpe.encode_documents(documents(spark, texts, extra=True), WORD_FILE).collect()
    assert len(rows) == len(texts)
    want = set()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                  hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text))
    assert {(r[0], r[1], r[2], r[3], tuple(r[4]), r[5]) for r in rows} == want
    assert bpe.encode_documents(documents(spark, texts).limit(0), WORD_FILE).count() == 0


def test_token_files(spark, coders):
    rng = random.Random(4)
    texts = [(i * 3, " ".join(words(rng, rng.randint(0, 60)))) for i in range(80)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rng.shuffle(texts)
    library = coders[1][1]
    docs = documents(spark, texts, extra=True)
    store = Store(spark, "files")
    files = store.save(token_files.write_files(docs, BYTE_FILE, f"{store.path}/f", length=64, sequences=4), "written")
    got = {r["doc_id"]: r for r in token_files.read_files(files, f"{store.path}/f").collect()}
    at, stream = 0, []
    for i, t in sorted(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
        stream += ids
    # any sequence on its own
    seen = []
    for row in sorted(files.collect()):
        one = token_files.SequenceFile(f"{store.path}/f", row["name"])
        n = -(-row["tokens"] // 64)
        order = rng.sample(range(n), n)
        parts = [x for _, x in sorted(((k, one.sequence(k)) for k in order), key=lambda x: x[0])]
        seen += np.concatenate([ids[mask] for ids, mask in parts]).tolist()
        assert all(len(ids) == 64 and mask.all() for ids, mask in parts[:-1])
        assert parts[0][0].base is not None  # a view of the mapped file
    assert seen == stream


def test_token_files_of_odd_tables(spark, coders):
    docs = documents(spark, [(None, "b"), (2, "x"), (2, "a"), (None, None)])
    rows = sorted(token_files.round_trip(docs, BYTE_FILE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 2, 2] and [r["n_tokens"] for r in rows] == [1, 2, 2, 2]
    assert token_files.round_trip(docs.limit(0), BYTE_FILE).count() == 0
