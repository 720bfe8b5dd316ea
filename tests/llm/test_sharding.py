import zlib

from pyspark.sql import functions as F

from ritardo.llm import sharding


def brute(rows, n):
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8, i)
                    for i, t in rows))
    total, at, out, slot = sum(r[3] for r in sized), 0, [], {}
    for _, _, crc, size, i in sized:
        shard = (2 * at + size) * n // (2 * total)
        out.append((str(i), size, crc, shard, slot.setdefault(shard, 0)))
        slot[shard] += 1
        at += size
    return sorted(out)


def test_against_brute_force(docs_of, sf_rows):
    rows = [(r[0], r[1]) for r in sf_rows] + [(None, None), (None, "x"), (10**6, ""), (10**6 + 1, "é" * 5000)]
    rows += [(77, "same")] * 300
    df = docs_of(rows, size=F.lit("x"), part=F.lit(1), shard=F.lit(2), tie=F.lit(3))
    got = sharding.byte_shards(df, 24).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, 24)


def test_few_rows_and_none(docs_of):
    assert sharding.byte_shards(docs_of([]), 24).count() == 0
    got = sharding.byte_shards(docs_of([(1, "a")]), 24).collect()
    assert [(r.shard, r.slot) for r in got] == [(12, 0)]
