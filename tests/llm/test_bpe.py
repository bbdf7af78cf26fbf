import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillroute.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_library():
    r = random.Random(1)
    ours, theirs = B.load(PATH), Tokenizer.from_file(PATH)
    alphabet = "abcdefghijklmnop etaoin  .,'sé\n\t0123ñ日本😀́\x00\xa0 \x1c\x85"
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    cases += ["".join(r.choice("aeions") for _ in range(r.randint(0, 200))) for _ in range(300)]
    cases += ["", "a" * 1000, "aa" * 333 + "b", "=" * 90, "x<|endoftext|> y<|endoftext|>", " a  b \n c ", "\n\n x"]
    for t in cases:
        ids = ours.encode(t)
        assert ids == theirs.encode(t, add_special_tokens=False).ids, t
        assert ours.decode(np.array(ids, int)).decode("utf-8", "replace") == theirs.decode(ids, skip_special_tokens=False)


def test_pair_table_equals_merging():
    """Whether two tokens survive next to each other, against merging their bytes anew."""
    r = random.Random(2)
    b, theirs = B.load(PATH), Tokenizer.from_file(PATH)
    letters = [i for i, t in b.bytes_of.items() if t.isalpha() and t.isascii()]
    for _ in range(3000):
        x, y = r.choice(letters), r.choice(letters)
        merged = theirs.encode((b.bytes_of[x] + b.bytes_of[y]).decode(), add_special_tokens=False).ids
        assert b.fits(x, y) == (merged == [x, y])


def test_digests(spark, docs_of):
    texts = ["Hello world", None, "", "ünï " * 30_000, "Hello world", (1, "more")]
    theirs = Tokenizer.from_file(PATH)
    out = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.round_trip_digests(docs_of(texts, extra=True)).collect())
    want = []
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert out == sorted(want)
    assert B.round_trip_digests(docs_of([])).count() == 0


def test_round_trip_of_tables(spark, docs_of):
    docs = docs_of(["one two", "", "drei <|endoftext|> vier"])
    back = {r["doc_id"]: r["text"] for r in B.decode_documents(B.encode_documents(docs)).collect()}
    assert back == {0: "one two", 1: "", 2: "drei <|endoftext|> vier"}
