import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from schemaweave.llm import chat, matroska

CONTROL = r"\### Assistant: </turn> ok"


def test_turns_come_back(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "<a:b> # \\ </turn>\n### x:\n"), (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL), (2, None, None, None), (3, 0, "as:si#st\\ant", "x"), (3, 0, "as:si#st\\ant", "x"), (None, 5, "assistant", "é漢😀"), (4, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", chat.text_parts(F.col("text")))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_turns(df.where("false"))).count() == 0


def test_parts(spark):
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part("text", text="see <image:0> "), part("image", ref="i.png", width=57, height=28), part("audio", ref="a.wav", seconds=1.5), part("document", ref="d.pdf", pages=2), None, part("odd", text="?")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts {chat.PARTS}")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert a.formatted == "### user:\nsee \\<image:0> <image:0><audio:1><document:2>?</turn>\n"
    assert [(x.position, x.kind, x.ref, x.n_tokens) for x in a.attachments] == [(0, "image", "i.png", 3), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 2048)]
    assert b.attachments == [] and b.loss_start == b.loss_end
    assert chat.read_back(a.formatted) == [("user", "see <image:0> <image:0><audio:1><document:2>?")]
    with pytest.raises(ValueError):
        chat.read_back("### user:\nx</turn>\njunk")


def test_parts_of_unknown_kind_and_tied_turns(spark):
    part = {"kind": "video", "text": None, "ref": "v.mp4", "width": None, "height": None, "seconds": None, "pages": None}
    a = chat.format_turns(spark.createDataFrame([(1, 0, "user", [part, part | {"kind": None, "ref": "x"}])], f"conv_id long, turn int, role string, parts {chat.PARTS}")).first()
    assert a.formatted == "### user:\n<video:0><file:1></turn>\n" and [(x.kind, x.ref, x.n_tokens) for x in a.attachments] == [("video", "v.mp4", 0), ("file", "x", 0)]
    rows = [(1, 0, "user2", "a"), (1, 0, "user", "$x"), (1, 0, "user", "#x"), (1, None, "zz", "first"), (1, 0, "us:er", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    want = "".join(f"{r}\n{t}\n" for _, _, r, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])))
    assert chat.conversation_digests(chat.format_turns(df)).first().turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_random_texts_come_back():
    rng = random.Random(3)
    for _ in range(500):
        role, text = ("".join(rng.choices("\\#<:/>turn \nx", k=rng.randint(0, 12))) for _ in range(2))
        made = f"{chat.HEAD}{chat.escape(role, True)}{chat.MID}{chat.escape(text)}{chat.TAIL}"
        assert chat.read_back(made * 2) == [(role, text)] * 2


def test_media_round_trip(spark):
    texts = [(1, ""), (2, None), (3, "a" * 192), (4, "é" * 9000), (4, "x"), (4, "x"), (None, "y" * 400_000)]
    df = spark.createDataFrame([(*t, "m") for t in texts], "doc_id long, text string, media string")
    media = matroska.text_media(df)
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in matroska.media_digests(media).collect())
    want = []
    for i, t in texts:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want)
    assert matroska.media_digests(matroska.text_media(df.where("false"))).count() == 0
    packets = matroska.packet_table(media.where("doc_id = 3"), "doc_id", "media").collect()
    assert [(p.packet, p.track, p.timestamp_ms, p.byte_length, p.cued, p.error) for p in packets] == [(0, 1, 0, 192, True, None)]


def test_all_lacings_and_unknown_sizes():
    frames = [b"a" * 3, b"b" * 300, b"c" * 255, b"d"]
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        block = matroska.laced_block(2, -5, [len(f) for f in frames], b"".join(frames), lacing)
        inner = matroska.uint(matroska.TIMESTAMP, 100) + block + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.vint(2) + b"\x00\x07\x00zz"))
        data = matroska._HEAD + matroska.element_id(matroska.SEGMENT) + b"\xff" + matroska.element_id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + inner + matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 900) + matroska.laced_block(1, 0, [2], b"hi", matroska.NONE))
        got = matroska.parse(data)
        assert got["error"] is None
        assert [(p[0], p[1], data[p[2] : p[2] + p[3]]) for p in got["packets"]] == [*((2, 95, f) for f in frames), (2, 107, b"zz"), (1, 900, b"hi")]


def test_frames_of_a_lace_follow_each_other():
    packets = matroska.parse(matroska.mux(b"q" * 192 * 100))["packets"]
    assert [p[1] for p in packets] == [24 * k for k in range(100)]


def test_digests_of_damaged_files(spark):
    whole = matroska.mux(b"q" * 192 * 3)
    df = spark.createDataFrame([(1, 5, None), (2, 5, bytearray(whole[:-150])), (3, 5, bytearray(b"")), (None, None, bytearray(whole))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in matroska.media_digests(df).collect()}
    assert got[1].payload_bytes is None and got[1].feature is None and got[1].n_bytes == 5
    assert "error=" in got[2].feature and got[2].media_bytes == len(whole) - 150
    assert got[3].payload_bytes == 0 and got[None].payload_bytes == 576 and "error" not in got[None].feature


def test_cut_files_give_whole_packets_and_an_error():
    data = matroska.mux(b"q" * 192 * 200)
    whole = matroska.parse(data)
    assert len(whole["packets"]) == 200 and [c for _, c in whole["cues"]] == whole["clusters"] and whole["error"] is None
    for n in range(0, len(data), 997):
        cut = matroska.parse(data[:n])
        assert whole["packets"][: len(cut["packets"])] == cut["packets"]
    assert matroska.parse(None)["error"] and matroska.parse(b"\x00\x00")["error"]
