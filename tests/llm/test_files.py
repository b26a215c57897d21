import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from samples import words
from shelfscope.llm import line_templates, packing, token_store, warc
from shelfscope.llm.files import read_binary, write_binary
from shelfscope.llm.shared import delete_scratch, new_folder
from shelfscope.llm.tokens import Encoder
from shelfscope.sources.kept import exists
from tokenizers import Tokenizer

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def odd_texts(n=4000):
    rng = np.random.default_rng(3)
    alphabet = list(" \n\t\r ab'sABé.,!\0\x1c 　\xa0́\x85​1٣ΣἈ   \n")
    return ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(n)]


def test_ids_equal_those_of_whole_texts():
    texts = odd_texts() + ["<|endoftext|> a<|endoftext|>b", "", words(500, 1)]
    for path in (BYTES, WORDS):
        got, want = Encoder(path, limit=300).encode(texts), library(path).encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def special_texts(n=3000):
    rng = np.random.default_rng(6)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|EndOfText|>."]
    alphabet = [*marks, " ", "  ", "\n", "\t", "a", "B", "it's", ".", "\u3000", "\u0301", "12"]
    return ["x <|endoftext|> y", *["".join(rng.choice(alphabet, rng.integers(0, 14))) for _ in range(n)]]


def test_ids_of_added_tokens_are_those_of_the_plain_library():
    texts = special_texts() + odd_texts()
    for path in (BYTES, WORDS):
        want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        for limit in (300, 800_000):
            got = Encoder(path, limit=limit, added_tokens=True).encode(texts)
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def latin_texts(n=6000):
    rng = np.random.default_rng(7)
    letters = list("abZQéÉèßÞÿÀñØ") * 3
    alphabet = [*letters, *"!%*-.,_'`@[]^{}~#/9²µªº×÷ŉ", "'s", "'Ll", "\0", " ", " ", "  ", "\n", "\n\n", "\u0301", "<|ENDOFTEXT|>"]
    return ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(n)]


def test_ids_of_latin_letters_and_marks_are_those_of_the_library():
    texts = latin_texts()
    for path in (BYTES, WORDS):
        for limit in (300, 800_000):
            want = library(path).encode_batch(texts, add_special_tokens=False)
            got = Encoder(path, limit=limit).encode(texts)
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_letters_with_marks_after_them_need_no_pass_through_the_whole_library(monkeypatch):
    text = "Élan señor größer, erlyhely&&& déjà!!\nÖl thisthhawhha%%% THORON.!!"
    for path in (BYTES, WORDS):
        coder, through = Encoder(path, added_tokens=True), []
        plain = coder._ids
        monkeypatch.setattr(coder, "_ids", lambda pieces, plain=plain, through=through: through.extend(pieces) or plain(pieces))
        got = np.frombuffer(coder.encode([text])[0], "<u4").tolist()
        assert got == library(path).encode(text, add_special_tokens=False).ids
        assert through == []


def test_stored_and_packed_ids_have_added_tokens(spark):
    docs = [(k, t) for k, t in enumerate(special_texts(40))]
    frame, path = spark.createDataFrame(docs, "doc_id long, text string"), new_folder(spark, "test")
    token_store.write_tokens(frame, path, BYTES, 0, partitions=2)
    stored = {r.doc_id: bytes(r.ids) for r in token_store.read_tokens(spark, path, with_ids=True).collect()}
    packed = {k: b"" for k, _ in docs}
    for r in packing.pack_documents(frame, WORDS).orderBy("doc_id", "start").collect():
        packed[r.doc_id] += bytes(r.ids)
    for found, file, end in ((stored, BYTES, 0), (packed, WORDS, 2)):
        plain = Tokenizer.from_file(file)
        want = {k: np.array([*plain.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes() for k, t in docs}
        assert found == want


def test_any_token_without_decoding():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 3000), rng.integers(0, 2**32, 2000), [0, 255, 256, 65535, 65536]])
    ids = rng.permutation(ids).astype("<u4")
    part = token_store.Shard(token_store.shard(3, 1, [(7, ids.tobytes())]) + token_store.ENDING)
    assert len(part.levels) == 4
    assert (part.tokens() == ids).all()
    assert [part.token(i) for i in range(len(ids))] == ids.tolist()


def test_token_files_round_trip(spark):
    docs = [(k * 7 % 50, words(k * 5, k)) for k in range(50)]
    path = new_folder(spark, "test")
    token_store.write_tokens(
        spark.createDataFrame(docs, "doc_id long, text string"), path, BYTES, 0, partitions=4, shard_tokens=500
    )
    assert read_binary(spark, path).count() > 4
    encode, before, want = library(BYTES).encode, 0, []
    for doc, text in sorted(docs):
        ids = np.array([*encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, before, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        before += len(ids)
    got = [tuple(r) for r in token_store.read_tokens(spark, path, with_ids=True).orderBy("doc_id").collect()]
    assert [(*g[:4], bytes(g[4])) for g in got] == want


def test_archives_are_plain_and_seekable(spark):
    pages = [(k, f"http://x/{k}", words(50, k % 7)) for k in range(40)] + [(40, None, None), (41, "u", "")]
    path = new_folder(spark, "test")
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    warc.write_archives(frame, path, frame_bytes=1000)
    seen = {}
    for row in read_binary(spark, path).collect():
        content = bytes(row.content)
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        bundle = warc.Bundle(content)
        assert plain == b"".join(bundle.at(k) for k in range(len(bundle.index)))
        for page in bundle.index["id"].tolist():
            seen[page] = warc.parse(bundle.record(page))
    assert len(seen) == 42
    for page, url, html in pages:
        head, block = seen[page]
        newest = max(p for p, _, h in pages if (h or "") == (html or ""))
        assert head["WARC-Type"] == ("response" if page == newest else "revisit")
        assert block == ((html or "").encode() if page == newest else b"")
        if page != newest:
            assert warc.page_of(head["WARC-Refers-To"]) == newest


def test_small_payloads_are_not_revisits(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = new_folder(spark, "test")
    warc.write_archives(frame, path, least_bytes=3)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, path).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_pieces_hold_every_id_once(spark):
    docs = [(k, words(k * 40, k)) for k in range(30)]
    found = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), WORDS, max_length=256)
    rows = sorted(map(tuple, found.select("doc_id", "start", "length", "doc_tokens", "ids").collect()))
    encode = library(WORDS).encode
    for doc, text in docs:
        own = [r for r in rows if r[0] == doc]
        ids = np.array([*encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(bytes(r[4]) for r in own) == ids.tobytes()
        assert [r[1] for r in own] == np.cumsum([0, *[r[2] for r in own]])[:-1].tolist()
        assert all(r[2] & (r[2] - 1) == 0 and r[2] <= 256 and r[3] == len(ids) for r in own)
    ids = [r[0] for r in found.select("sequence_id").collect()]
    assert len(set(ids)) == len(ids)


def test_cuts():
    assert packing.cuts(1, 8) == [1]
    assert packing.cuts(29, 8) == [8, 8, 8, 4, 1]
    assert packing.cuts(16, 8) == [8, 8]


def test_a_changed_payload_is_told(spark):
    """A byte of a response differs from what its headers say."""
    writer = warc.Writer(1000)
    writer.add(1, warc.record(1, "u", b"good page", None))
    writer.add(2, warc.record(2, "v", b"some page", None).replace(b"some page", b"same page"))
    path = new_folder(spark, "test")
    write_binary(spark.createDataFrame([(writer.finish(),)], "file binary"), "file", path, warc.ENDING)
    with pytest.raises(Exception, match="its headers say"):
        warc.read_archives(spark, path).collect()


def test_an_empty_table_is_read_back(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = new_folder(spark, "test")
    warc.write_archives(none, path)
    assert warc.read_archives(spark, path).count() == 0
    path = new_folder(spark, "test")
    token_store.write_tokens(none.selectExpr("page_id AS doc_id", "html AS text"), path, BYTES)
    assert token_store.read_tokens(spark, path).count() == 0


def test_nothing_is_left_after_deleting_scratch(spark):
    docs = spark.createDataFrame([(k, f"{words(9, 1)}\n{words(9, k)}") for k in range(5)], "doc_id long, text string")
    found = line_templates.drop_lines(docs).collect()
    folder = new_folder(spark, "test").rsplit("/", 1)[0]
    assert found and exists(spark, folder) and os.listdir(folder)
    delete_scratch(spark)
    assert os.listdir(folder) == []
