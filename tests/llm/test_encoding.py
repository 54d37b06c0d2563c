import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import chunk_reuse
from gridloom.llm.chunk_reuse import ChunkCoder, cut_points
from gridloom.llm.encoding import WordEncoder

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aB1 \n\t\r.,'\"é́ſΣςİ\x1c​ x²½ªº\xa0\xad–—’…€ÀÿŁƒẞ日本 🙂\x85\x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_match_the_library(library):
    words, rng = WordEncoder(PATH, limit=50), random.Random(1)
    texts = ["".join(rng.choice(LETTERS + "'s're<|endoftext|>") for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    for text in [*texts, "it's I'LL <|endoftext|>x<|ENDOFTEXT|>", "", " ", *[t or "" for _, t in ODD]]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_chunks_are_repaired_exactly(library):
    rng = random.Random(2)
    coder = ChunkCoder(WordEncoder(PATH))
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(900))
    texts = [f"Start {n}. {shared} End {n}" for n in range(4)] + ["y" * 20000, shared.replace(" ", ""), "a b " * 3000, shared.replace("a", "é́")]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == ids
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert coder.reused > 0 and coder.repaired > 0


def test_cuts_depend_on_content():
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefghij ") for _ in range(20000))
    ends = lambda t, skip: {e - skip for e in cut_points(t)}
    common = ends(body, 0) & ends("some other beginning" + body, 20)
    assert len(common) > 5
    assert cut_points("") == [0] and sum(np.diff([0, *cut_points(body)])) == len(body)


def test_op2(spark, sf, library):
    rows = chunk_reuse.op2(spark, sf()).collect()
    want = []
    for doc, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert chunk_reuse.op2(spark, sf(empty=True)).count() == 0


def test_columns_round_trip(spark, odd):
    out = chunk_reuse.decode_column(chunk_reuse.encode_column(odd, "text", PATH), "ids", PATH)
    assert set(odd.columns) < set(out.columns) and out.where("doc_id = 10").first()["decoded"] == "one</w>"
