import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillroute.llm import packing as P


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    r = random.Random(seed)
    cap = r.choice([16, 64, 257])
    hist = Counter(r.randint(1, cap) for _ in range(r.randint(1, 400)))
    plan = P.plan_patterns(dict(hist), cap)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= cap
        for x in pattern:
            used[x] += n
    assert used == hist
    total = sum(n for _, n in plan)
    assert total <= 1.25 * -(-sum(k * v for k, v in hist.items()) // cap) + 1


def test_exact_complements_come_first():
    plan = P.plan_patterns({10: 3, 6: 3, 7: 2, 5: 2, 4: 2, 16: 1}, 16)
    assert all(sum(p) == 16 for p, _ in plan)
    assert P.plan_patterns({}, 16) == []
    with pytest.raises(ValueError):
        P.plan_patterns({17: 1}, 16)


def reference(text, cap=4096):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
    return [ids[i : i + cap] for i in range(0, len(ids), cap)]


def test_pieces_and_places(spark, docs_of):
    texts = ["Hello, world!", None, "", "a b c " * 3000, "it's 2x O'Neil's\x1cend <|endoftext|> é İstanbul ㍿", "Hello, world!", "x" * 9000, (7, "twice"), (7, "again")]
    out = P.pack(docs_of([(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)], extra=True)).collect()
    want = defaultdict(list)
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        for n, ids in enumerate(reference(t)):
            want[i].append((n, 4096 * n, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark, docs_of):
    assert P.pack(docs_of([])).count() == 0


def test_encoder_equals_the_library():
    r = random.Random(3)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = P.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    alphabet = "abc dEF'sé\n\t01 ́\xa0\x1c\x85ẞİ.,#"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    for t, raw in zip(texts, enc.encode_all(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_exact_sums_go_on_after_a_pair_that_is_short_of_copies():
    """1500 + 1500 + 1096 is short of a copy; 1450 would mislead best fit."""
    plan = P.plan_patterns({1500: 1, 1450: 1, 1400: 1, 1196: 1, 1096: 1}, 4096)
    assert ((1500, 1400, 1196), 1) in plan
    assert sorted(x for lengths, n in plan for x in lengths * n) == [1096, 1196, 1400, 1450, 1500]
