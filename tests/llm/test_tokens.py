import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import bpe, tokens
from veilspark.llm.queries import vocabulary

SAMPLES = ["", " ", "Hello  world, it's   we'll\n\n done ", "naïve Ünïcode 你好 😀😀 \x85\xa0x", "a<|endoftext|>b<|endof", "Σίσυφος ΟΔΟΣ ²½Ⅷ", "x" * 3000, "don't 'l 'll !'s\x1cq"]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def same(libraries, name, text):
    want = libraries[name].encode(text, add_special_tokens=False).ids
    ids, shown = bpe.encode_text(vocabulary(name), text)
    assert ids == struct.pack(f"<{len(want)}I", *want) and bpe.count_text(vocabulary(name), text) == len(want)
    if name.startswith("word"):
        assert shown == libraries[name].decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("text", SAMPLES)
def test_ids_are_the_library_s(libraries, name, text):
    same(libraries, name, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdehlorstvABΣσ'’.,! \n\t\x85\xa0019²éüßñ你😀<|>")), max_size=60))
def test_any_text(libraries, text):
    for name in libraries:
        same(libraries, name, text)


@pytest.mark.parametrize("text", SAMPLES[:6] + SAMPLES[7:])
def test_every_prefix(libraries, text):
    model = bpe.load(vocabulary("byte_bpe_50k.json"))
    counts = model.prefix_counts(text)
    lib = libraries["byte_bpe_50k.json"]
    assert counts == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    cut = model.truncate(text, 5)
    assert counts[len(cut)] <= 5 and all(c > 5 for c in counts[len(cut) + 1 :][:1])


def test_ids_of_every_character(libraries):
    """Whatever Unicode version knows them; each character stands alone, in a word and by a number."""
    found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    name = "word_bpe_49k.json"
    texts = ["".join(f"{chr(c)} a{chr(c)}B 1{chr(c)}\n" for c in found[at : at + 128]) for at in range(0, len(found), 128)]
    for text, want in zip(texts, libraries[name].encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode_text(vocabulary(name), text)[0] == struct.pack(f"<{len(want.ids)}I", *want.ids)
    for text in ("".join(map(chr, found[at : at + 4000])) for at in range(0, 0x3000, 4000)):
        same(libraries, "byte_bpe_50k.json", text)


def test_prefix_columns(spark, libraries):
    path = vocabulary("byte_bpe_50k.json")
    rows = spark.createDataFrame([("It's a text", 1), (None, 2), ("", 3)], "text string, n int").select("n", tokens.prefix_counts(F.col("text"), path).alias("counts"), tokens.truncated(F.col("text"), path, 2).alias("cut"), tokens.encode(F.col("text"), path).alias("e")).collect()
    got = {r.n: r for r in rows}
    assert got[1].counts == bpe.load(path).prefix_counts("It's a text") and got[1].cut == "It's" and got[1].e.ids == bpe.encode_text(path, "It's a text")[0]
    assert got[2].counts == [0] and got[2].cut is None and got[2].e.ids == b"" and got[3].cut == ""


def test_tables(spark, libraries):
    rows = [(1, "It's a text", "x"), (1, "It's a text", "x"), (2, None, None), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokens.count_tokens(docs, vocabulary("byte_bpe_50k.json"), limit=3).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [("1", 11, 4, True), ("1", 11, 4, True), ("2", 0, 0, False), ("None", 0, 0, False)]
    done = {r.doc_id: r for r in tokens.encode_digests(docs, vocabulary("word_bpe_49k.json")).collect()}
    assert done[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and done[1].n_tokens == 4
    assert tokens.count_tokens(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
    assert tokens.encode_digests(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_workers_keep_the_tokens_of_recent_pieces_only(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"the w{k}x{j}" for j in range(50)) for k in range(20)]
    want = [(bpe.encode_text(path, t), bpe.count_text(path, t)) for t in texts]
    caches = bpe.encoded(path), bpe.counted(path)
    for c in caches:
        c.clear()
        c.before.clear()
    monkeypatch.setattr(bpe, "RECENT", 30)
    assert [(bpe.encode_text(path, t), bpe.count_text(path, t)) for t in texts] == want
    assert all(len(c) <= 30 and len(c.before) <= 30 and ("the" in c or "the" in c.before) for c in caches)


def test_what_is_held_of_a_piece_is_its_ids():
    """Not its decoded text, too, which is looked up for whole texts."""
    path = vocabulary("word_bpe_49k.json")
    model = bpe.load(path)
    cache = bpe.Encoded(model)
    text = "naïve it's 1999 <b>!! " + " ".join(f"ernta{k}nathewh你" for k in range(50))
    held = [cache[p] for p in model.words(text)]
    assert all(type(h) is bytes and len(h) == 4 * model.word_count(p) for p, h in cache.items())
    ids, shown = bpe.encode_text(path, f"{text}<|endoftext|>")
    assert ids == b"".join(held) + struct.pack("<I", model.special["<|endoftext|>"])
    assert shown == " ".join(model.names[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)) == str(model.shown(ids), "utf-8")
    assert bytes(model.shown(b"")) == b""


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_single_symbols_are_not_searched_for(libraries, monkeypatch, name):
    """An end of a prefix costs what may end there, not its last symbol, which needs no search; the ids are the
    library's, also when pairs found out are let go of all the time."""
    model = bpe.PrefixBpe(vocabulary(name))
    assert all(size > 1 for _, (_, size) in model.automaton.iter("".join(model.single) + "there"))
    monkeypatch.setattr(bpe, "CACHE_LIMIT", 3)
    for piece in ("a", "'", "erntanathewh", "aaaaaaaa", "ÿüöñ", "你😀", "xqzjkv" * 30):
        want = libraries[name].encode(piece, add_special_tokens=False).ids
        assert b"".join(map(model.word_ids, model.words(piece))) == struct.pack(f"<{len(want)}I", *want)
        assert sum(map(model.word_count, model.words(piece))) == len(want)
        symbols = model.symbols(model.words(piece)[0])
        assert len(model.fits) <= 3 and model.counts(symbols)[-1] == model.word_count(model.words(piece)[0])
