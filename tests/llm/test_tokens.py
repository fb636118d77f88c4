import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from quillon.llm import packing, token_files
from quillon.llm.tokens import default_vocabulary
from tests.llm.fixtures import empty, rows, table


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_against_whole_texts(spark, whole):
    expected, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: (x[0] is not None, x[0], x[1])):
        ids = whole(text) + [2]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_files(table(spark)).orderBy("start").collect()]
    assert got == expected
    assert token_files.token_files(empty(spark)).collect() == []


def test_random_access_and_small_blocks(spark, tmp_path, whole):
    token_files.write_token_files(table(spark), str(tmp_path / "ids"), block_ids=100)
    files = spark.read.parquet(str(tmp_path / "ids")).orderBy("part", "block").collect()
    assert len(files) > 5
    image = token_files.TokenImage(files[-1]["image"])
    flat = image.ids()
    assert [image[i] for i in range(image.n_ids)] == flat.tolist()
    by_id = {r[0]: r[1] for r in rows()}
    for k, doc_id in enumerate(image.doc_ids.tolist()):
        assert image.document(k) == whole(by_id[doc_id]) + [2]
    with pytest.raises(IndexError):
        image[image.n_ids]
    back = token_files.read_token_files(spark.read.parquet(str(tmp_path / "ids"))).count()
    assert back == len(rows())


def test_rows_without_an_id_are_dealt_out_by_text(spark, tmp_path, whole):
    data = [(None, f"row {k} of many") for k in range(900)] + [(k, "x") for k in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    token_files.write_token_files(df, str(tmp_path / "ids"))
    files = spark.read.parquet(str(tmp_path / "ids"))
    assert files.where(F.col("first_doc") == token_files.NULL_ID).select("part").distinct().count() > 3
    got = [tuple(r) for r in token_files.read_token_files(files).orderBy("start").collect()]
    expected, start = [], 0
    for doc_id, text in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = whole(text) + [2]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == expected


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 200_000, 37))])
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    image = token_files.TokenImage(token_files.encode_image(np.array([5]), np.array([0, len(ids)]), ids))
    assert image.ids().tolist() == ids.tolist()
    assert [image[i] for i in range(0, len(ids), 11)] == ids[::11].tolist()


def test_packing(spark, whole):
    got = packing.pack_documents(table(spark)).collect()
    expected = []
    for r in rows():
        ids = whole(r[1]) + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected.append((r[0], piece, start, len(part), crc(part)))
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(expected, key=order)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(empty(spark)).collect() == []


def best_fit_decreasing(lengths, capacity):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=room.__getitem__)] -= length
        else:
            room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_as_good_as_best_fit_on_documents(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.choice([16, 64, 300]))
    lengths = r.integers(1, capacity + 1, 200).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots = packing.plan(counts, capacity)
    assert len({f + k for _, a, b, f, _ in slots for k in range(b - a)}) <= best_fit_decreasing(lengths, capacity) + 1
    assert sum(b - a for _, a, b, _, _ in slots) == len(lengths)


def test_least_id_is_no_null(spark):
    rows = [(-(2**63), "the least"), (None, "none"), (None, "none"), (2**63 - 1, "the greatest"), (0, None)]
    got = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(2**63), 0, 2**63 - 1]
