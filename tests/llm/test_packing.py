import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessaprobe.llm import packing
from tests.llm.conftest import invented

ODD = [
    "", None, "  \n", "a<|endoftext|>b 's it's don't 12ab3 x́ é! É.É K \xa0z\x1cq  w", "<|ENDOFTEXT|> THE'S o'clock' <|startoftext|>", "naïve“quotes” — dash…", "日本語 テスト ab--cd",
    "\U0001f600 hi!!\n\n?", "É́ ok ﬁne ǅ İstanbul ẞ", "under_score __x__ a.b,c;d", "word " * 5000,
]


def ids_of(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_round_trip(documents, spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, invented(i, 7 * i)) for i in range(60)] + [(3, ODD[3]), (None, "null id")]
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append(ids_of(text))
    got = packing.packed(documents(rows, ("start", "part")).repartition(3)).collect()
    assert sum(p.length for p in got) == sum(len(x) for v in want.values() for x in v)
    sequences = defaultdict(list)
    for p in got:
        assert any(
            p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in want[p.doc_id]
        )
        sequences[p.sequence_id].append((p.offset, p.length, p.padded_length))
    last = max(sequences)
    assert sorted(sequences) == list(range(last + 1))
    for k, parts in sequences.items():
        place = 0
        for offset, length, _ in sorted(parts):
            assert offset == place and length > 0
            place += length
        assert place == 2048 or k == last
        assert {x[2] for x in parts} == {place if place & (place - 1) == 0 else 2048}
    by_doc = defaultdict(int)
    for p in got:
        by_doc[p.doc_id] += p.length
    assert by_doc == {k: sum(map(len, v)) for k, v in want.items()}


def test_cache_overflow_changes_nothing(documents):
    rows = [(i, invented(i, 300, 10**6)) for i in range(6)]
    small = packing.packed(documents(rows), packing.Pack(cache=50)).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, packing.packed(documents(rows)).collect()))


def test_empty_table(documents):
    assert packing.packed(documents([])).collect() == []
