"""Workers give back what they have freed."""

import gc
import hashlib
import re
import weakref

import pyarrow as pa
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilspark.llm import bpe, common, lines, neardup, tokens
from veilspark.llm.queries import vocabulary


def resident():
    with open("/proc/self/status") as f:
        return int(re.search(r"VmRSS:\s+(\d+)", f.read())[1]) / 1024


def test_freed_memory_goes_back():
    def hold(batches):
        held = [bytes(60_000) for _ in range(3000)]
        pinned.append(bytes(60_000))  # stands above them, so that nothing goes back by itself
        yield from batches
        del held

    pinned = []
    before = resident()
    assert list(common.freeing(hold)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 40


def test_python_of_the_stages_gives_memory_back():
    for module in (lines, neardup, common):
        with open(module.__file__) as f:
            assert not re.search(r"\.mapInArrow\((?!freeing\()", f.read())


def test_unassigned_characters_are_those_of_python():
    import sys
    import unicodedata

    free = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    known = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) != "Cn")
    assert bpe.unassigned().fullmatch(free[0]) and len(bpe.unassigned().findall(free)) == len(free)
    assert not bpe.unassigned().search(known)


class Docs:
    """Takes what encode_digests gives to Spark."""

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run, self.given = run, schema
        return self


def test_workers_let_go_of_the_vocabulary_after_a_task():
    path = vocabulary("word_bpe_49k.json")
    texts = [None, "", "Hello  world, it's \U0001f600", *(f"the w{k}x ͸" for k in range(597))]
    want = [bpe.encode_text(path, t) for t in texts]
    held = [weakref.ref(bpe.load(path)), weakref.ref(bpe.encoded(path))]
    batch = pa.record_batch([pa.array(range(600), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    job = tokens.encode_digests(Docs(), path)
    out = list(job.run(iter([batch, batch])))
    assert not any(ref() for ref in held) and bpe.load.cache_info().currsize == 0
    assert max(b.num_rows for b in out) <= tokens.TEXTS and job.given.names == out[0].schema.names
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert rows == [(k, len(ids) // 4, sha(ids), sha(shown.encode())) for k, (ids, shown) in enumerate(want)] * 2
    some = job.run(iter([batch, batch]))
    next(some)
    some.close()  # a task that ends early
    assert bpe.load.cache_info().currsize == 0


def test_what_went_in_circles_goes_with_the_vocabulary():
    class Ring:
        pass

    gc.disable()
    try:
        ring = Ring()
        ring.me, ref = ring, weakref.ref(ring)
        del ring
        bpe.forget()
        assert ref() is None
    finally:
        gc.enable()
