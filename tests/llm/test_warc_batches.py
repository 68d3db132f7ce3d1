"""Payloads leave the reading tasks in bounded batches, and not at all where only the digests are asked for."""
import pyarrow as pa

from sparkloom.llm import warc


def test_batches_are_bounded(spark):
    pages = spark.range(40).selectExpr("id as page_id", "'u' as url", "concat(repeat('a', 500000), cast(id as string)) as html").coalesce(1)
    index = warc.write(pages)
    rows = pa.RecordBatch.from_pylist([r.asDict() for r in index.orderBy("archive", "offset").collect()], schema=warc.INDEX)
    sizes = [b.column("payload").nbytes for b in warc._read([rows], True)]
    assert sum(sizes) >= 40 * 500000 and max(sizes) < warc.BATCH_BYTES + 1000000
    bare = list(warc._read([rows], False))
    assert sum(b.num_rows for b in bare) == 40 and not any(b.column("payload").nbytes > 1000 for b in bare)
    assert {r.page_id: r.payload_bytes for r in warc.read(index, bodies=False).collect()} == {i: 500000 + len(str(i)) for i in range(40)}
