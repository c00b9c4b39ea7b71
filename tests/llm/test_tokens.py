import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantspark.llm import packing as P
from quantspark.llm import records as R
from quantspark.llm.tokenizing import WordEncoder, vocabulary

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TOKENIZERS = {n: Tokenizer.from_file(vocabulary(n)) for n in NAMES}
ENCODERS = {n: WordEncoder(vocabulary(n), "<u2", keep=200) for n in NAMES}


def ids(name, text):
    return TOKENIZERS[name].encode(text or "", add_special_tokens=False).ids


ALPHABET = ["a", "B", "é", " ", " ", "\n", "'s", ".", "!", "|", "1", "\t", "ß", "́", "中", "_", "<|endoftext|>", "　", "\r", "Σ", "İ", "Å", "the ", "word.", "<|ENDOFTEXT|>", "\x1c", "\x85", "É", "\u0958"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(ALPHABET), max_size=25))
def test_pieces_give_the_ids_of_whole_texts(name, parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODERS[name].encode([text])[0], "<u2").tolist() == ids(name, text)


@pytest.mark.parametrize("name", NAMES)
def test_small_documents_and_a_small_cache(spark, small, name):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for lo in range(0, len(texts), 37):
        for text, raw in zip(texts[lo : lo + 37], ENCODERS[name].encode(texts[lo : lo + 37])):
            assert np.frombuffer(raw, "<u2").tolist() == ids(name, text)


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_records_round_trip(awkward):
    manifest = R.write_token_records(awkward, vocabulary(NAMES[0]), end_id=2, files=3)
    got = sorted(R.read_token_records(manifest).collect(), key=lambda r: r.start)
    rows = awkward.select("doc_id", "text").collect()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    at, found = 0, defaultdict(list)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids) and r.ids[-1] == 2
        found[r.doc_id].append(r.ids[:-1])
        at += r.n_tokens
    want = defaultdict(list)
    for r in rows:
        want[r.doc_id].append(ids(NAMES[0], r.text))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    file = manifest.orderBy("part").first()
    again = list(R.read_records_at(file["dir"], file["name"], [1, 0]))
    assert again[1][1].tolist() == got[0].ids and again[0][1].tolist() == got[1].ids


def test_damage_is_found():
    record = R.frame(b"payload")
    assert R.unframe(record) == b"payload"
    for i in range(len(record)):
        bad = bytearray(record)
        bad[i] ^= 1
        with pytest.raises((ValueError, struct.error)):
            R.unframe(bytes(bad))


def test_nothing_to_write_or_pack(nothing):
    manifest = R.write_token_records(nothing, vocabulary(NAMES[0]))
    assert manifest.count() == 0 and R.read_token_records(manifest).count() == 0
    assert P.pack_documents(nothing, vocabulary(NAMES[1])).count() == 0


def test_first_fit_is_first_fit():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    bins, offsets = P.first_fit_decreasing(lengths, 100)
    free: list[int] = []
    for x, b, at in zip(lengths, bins, offsets):
        want = next((i for i, f in enumerate(free) if f >= x), len(free))
        if want == len(free):
            free.append(100)
        assert (b, at) == (want, 100 - free[want])
        free[want] -= x


@pytest.mark.parametrize("per_group", [4096, 5])
def test_packing_holds_every_id_once(awkward, per_group):
    got = P.pack_documents(awkward, vocabulary(NAMES[1]), capacity=64, docs_per_group=per_group, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == crc(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = defaultdict(list)
    for r in awkward.select("doc_id", "text").collect():
        want[r.doc_id].append(ids(NAMES[1], r.text) + [1])
    total = lambda lists: sorted(x for part in lists for x in part)
    assert {k: total(x for _, x in v) for k, v in pieces.items()} == {k: total(v) for k, v in want.items()}
    assert len(want[103]) == 1 and sum((x for _, x in sorted(pieces[103])), []) == want[103][0]


def test_small_documents_pack_with_little_padding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = P.packed_sequences(docs, vocabulary(NAMES[1])).collect()
    assert all(len(r.input_ids) == 2048 and r.n_tokens <= 2048 for r in got)
    assert sum(r.n_tokens for r in got) / (2048 * len(got)) > 0.97
