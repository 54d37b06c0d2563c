import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import wavelet
from gridloom.llm.wavelet import WaveletFile, write_file

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("size", [0, 1, 7, 8, 1000, 300_000])
def test_access_rank_select(size, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 1 << 10)
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.zipf(1.3, size), 40000).astype(np.uint16)
    wm = WaveletFile(write_file(ids, [5, None], np.array([size, 0])))
    assert wm.doc_ids == [5, None] and wm.lengths.tolist() == [size, 0]
    assert np.array_equal(wm.tokens(), ids)
    for i in rng.integers(0, size, 20) if size else []:
        token = int(ids[i])
        assert wm.access(int(i)) == token
        assert wm.rank(token, int(i)) == int((ids[:i] == token).sum())
        assert wm.count(token) == int((ids == token).sum())
        places = np.flatnonzero(ids == token)
        k = int(rng.integers(0, len(places)))
        assert wm.select(token, k) == places[k]
    assert wm.count(65000) == 0 and wm.count(70000) == 0
    with pytest.raises(IndexError):
        wm.access(size)


def test_compresses():
    ids = np.tile(np.arange(64, dtype=np.uint16), 4000)
    assert len(write_file(ids, [1], np.array([len(ids)]))) < len(ids) // 4


def test_too_large_ids_are_refused():
    with pytest.raises(ValueError):
        write_file(np.array([70000], np.uint32), [1], np.array([1]))


def expected(rows):
    t, out, at = Tokenizer.from_file(PATH), [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_op10(spark, sf):
    got = [tuple(r) for r in wavelet.op10(spark, sf()).orderBy("start").collect()]
    assert got == expected(ODD)
    assert wavelet.op10(spark, sf(empty=True)).count() == 0


def test_many_files(spark, tmp_path):
    rows = [(n * 7 % 501, f"text number {n} " * (n % 9)) for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wavelet.write_shards(docs, str(tmp_path / "w"), PATH, 1, full=300)
    assert spark.read.parquet(str(tmp_path / "w")).count() > 20
    assert [tuple(r) for r in wavelet.read_shards(spark, str(tmp_path / "w")).orderBy("start").collect()] == expected(rows)
