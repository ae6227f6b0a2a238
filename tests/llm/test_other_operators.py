import io
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from setlight.llm import quotes, topk, warc


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(15)]
    return [*rows, (300, None), (301, []), (302, [1.0] * 7 + [float("nan")]), (400, [0.5] * 3), (401, [0.1] * 3), (303, [1.0] * 7 + [None]), (None, [0.1] * 8), (20, rows[20][1]), (500, [float("inf")] + [0.0] * 7)]


def test_topk(spark):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id long, vector array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, F.col("id") % 20 == 0, pivots=6).collect())
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v)))[:10]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(wanted)
    assert topk.top_k(frame.where("false"), F.lit(True)).count() == 0


def test_topk_prunes_blocks_and_stays_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] * (1 + i % 3) + rng.normal(0, 0.02, 16)]) for i in range(1200)]
    monkeypatch.setattr(topk, "BLOCK_BYTES", 16 * 8 * 40)
    scaled = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") % 60 == 0, k=5).collect()
    for q in range(0, 1200, 60):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)[:5]
        assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(-s, i) for s, i in best]
    ids, x = np.arange(1200), np.array([scaled[i] for i in range(1200)], float)
    far = topk.distances(x, x[:32])
    blocks = [np.arange(k, 1200, 6) for k in range(6)]  # neighbours together, as pack() orders them
    seen = 0
    for q in range(0, 1200, 60):
        query = (ids[q : q + 1], x[q : q + 1], far[q : q + 1], np.array([topk.floor_of(q, x[q], (ids, x), 5)]))
        seen += sum(topk.best_of_block(query, (ids[b], x[b], far[b]), 5)[1] for b in blocks)
    assert seen < 0.25 * 20 * 1200


def test_topk_does_not_broadcast_copies_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 8 * 2)
    monkeypatch.setattr(topk, "SAMPLE", 20)
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, rng.normal(0, 1, 8).tolist()) for i in range(200)], "id long, vector array<double>").repartition(8)
    found = topk.top_k(frame, F.col("id") % 10 == 0)
    assert len(found.collect()) == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_topk_of_wide_components(spark):
    rows = [(1, [1e6, 3.0]), (2, [1e6, 1.0]), (3, [-1e6, 2.0]), (4, [1e15, 1e15]), (100, [1e6, 2.5]), (200, [1e15, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") % 100 == 0).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (100, 200):
        best = sorted((-limit(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)
        assert sorted((-r.score, r.vec_id) for r in got if r.query_id == q) == best


@pytest.mark.parametrize("most", [1 << 19, 1 << 29])
def test_topk_of_many_wide_vectors(spark, most):
    """Scores above 2**53, more of them than a query keeps: floors must not lose the candidate that set them."""
    rng = np.random.default_rng(most % 1000)
    rows = [(i, [float(int(x)) / 1024 for x in rng.integers(0, most, 4)]) for i in range(1000)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    got = topk.top_k(spark.createDataFrame(rows, "id long, vector array<double>"), F.col("id") % 50 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in range(0, 1050, 50):
        assert found[q] == sorted((-limit(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:10]


def test_floors_are_never_above_their_scores():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.floor(rng.uniform(0, 2.0**24, (40, 4)))
        exact = sorted((sum(int(a) * int(b) for a, b in zip(x[0], v, strict=True)) for v in x[1:]), reverse=True)
        assert topk.floor_of(0, x[0], (np.arange(40), x), 10) <= exact[9]


def pages():
    big = "x" * 300_000
    return [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", big), (0, "u", big), (7, "z", "one"), (7, "z", "one"), (None, "n", "one"), (8, "q", "one")]


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    rows = pages()
    manifest = warc.write_packages(spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, payload_digest string"), least_bytes=least, member_bytes=1000, package_bytes=2000)
    got = warc.read_packages(manifest).collect()
    wanted = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == payload]
        origin = min(same) if page_id is not None and len(payload) >= least and page_id > min(same) else None
        wanted.append((str(page_id), len(payload), warc.digest32(payload), "response" if origin is None else "revisit", str(origin)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(wanted)
    assert all(bytes(r.payload) == (b"" if r.record_type == "revisit" else bytes(r.payload)) and (r.record_type == "revisit" or len(r.payload) == r.payload_bytes) for r in got)
    assert warc.read_packages(warc.write_packages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def zip64_bytes(data: bytes) -> bytes:
    """A ZIP file whose sizes, offsets and counts are only in ZIP64 fields."""
    name = b"archive/a.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    at = len(local) + len(data)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    return local + data + central + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"


def test_zip64_directory():
    blob = zip64_bytes(b"payload")
    z = warc.ZipRanges(io.BytesIO(blob), len(blob))
    e = z.entries["archive/a.warc.gz"]
    assert (e.size, e.header) == (7, 0) and z.read(z.start(e.name), e.size) == b"payload"


def test_ordinary_zip_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("a", b"1" * 70_000)
        f.writestr(zipfile.ZipInfo("b"), b"22", zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05\x06 in a comment"
    blob = out.getvalue()
    z = warc.ZipRanges(io.BytesIO(blob), len(blob))
    assert z.read(z.start("a"), 3) == b"111" and set(z.entries) == {"a", "b"}
    with pytest.raises(ValueError, match="not stored"):
        z.start("b")
    with pytest.raises(ValueError, match="central directory"):
        warc.ZipRanges(io.BytesIO(blob[:100]), 100)


def conversation():
    return [
        (1, 0, "a", "Shall we meet on Monday?\nThe room is free."),
        (1, 1, "b", "On Sunday a wrote:\n> Shall we meet on Monday?\n> The room is free.\nYes, Monday is good."),
        (1, 2, "c", "An unrelated thread starts here."),
        (1, 3, "a", "> Yes, Monday is GOOD.\n>> Shall we  meet on Monday?\nThen it is settled."),
        (1, 4, "d", ">An unrelated thread starts here.\nIndeed it does."),
        (1, 5, "e", "> Not said by anybody at all\nHm."),
        (2, 0, "x", "> Shall we meet on Monday?\nNot this conversation."),
        (2, 1, "y", None), (3, None, "z", "> Shall we meet on Monday?"), (None, 0, "n", "text"), (2, 1, "y", None), (4, 0, "l", "long " * 50_000), (4, 1, "l", "> " + "long " * 50_000 + "\nok"),
    ]


def test_quotation_linking(spark):
    frame = spark.createDataFrame([(*m, "k") for m in conversation()], "conv_id long, turn long, role string, text string, depth string")
    rows = quotes.link_quotations(frame).collect()
    assert len(rows) == len(conversation())
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in rows}
    assert {t: got[(1, t)] for t in range(6)} == {0: (None, 0, 0), 1: (0, 0, 1), 2: (None, 2, 0), 3: (1, 0, 2), 4: (2, 2, 1), 5: (None, 5, 0)}
    assert [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.reply_order)] == [0, 1, 3, 2, 4, 5]
    assert got[(2, 0)] == (None, 0, 0) and got[(4, 1)] == (0, 0, 1)
    texts = {(r.conv_id, r.turn): r.text for r in rows}
    assert texts[(1, 1)] == "Yes, Monday is good." and texts[(1, 3)] == "Then it is settled." and texts[(2, 1)] == ""
    assert sorted(r.reply_order for r in rows if r.conv_id == 2) == [1, 2, 3]
    assert [r.reply_order for r in rows if r.conv_id is None or r.turn is None] == [None, None]
    assert quotes.link_quotations(frame.where("false")).count() == 0


def test_clashing_columns_do_not_matter(spark):
    frame = spark.createDataFrame([(1, 0, "a", "Hello", 7, 7, 7), (1, 1, "b", "> Hello\nYes", 7, 7, 7)], "conv_id long, turn long, role string, text string, row_id long, own long, lines long")
    assert {r.turn: r.parent_turn for r in quotes.link_quotations(frame).collect()} == {0: None, 1: 0}


def test_short_messages_are_linked(spark):
    rows = [(1, 0, "a", "Lunch?"), (1, 1, "b", "> Lunch?\nYes."), (1, 2, "c", "An unrelated thread starts here."), (1, 3, "a", "> Yes.\nok"), (1, 4, "b", "> ok\n好"), (1, 5, "c", ">好\nHm"), (1, 6, "d", ">\n> \nNothing quoted"), (2, 0, "x", ""), (2, 1, "y", ">\nEmpty")]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth) for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[(1, t)] for t in range(7)] == [(None, 0, 0), (0, 0, 1), (None, 2, 0), (1, 0, 2), (3, 0, 3), (4, 0, 4), (None, 6, 0)]
    assert got[(2, 0)] == (None, 0, 0) and got[(2, 1)] == (None, 1, 0)


def test_reply_order_over_many_threads(spark):
    rng = random.Random(2)
    rows = [(9, i, "r", f"Message number {i} says something." if i == 0 or rng.random() < 0.5 else f"> Message number {rng.randrange(i)} says something.\nMessage number {i} says something.") for i in range(1500)]
    got = {r.turn: r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    parent = {i: int(t.split()[3]) if t.startswith(">") else None for _, i, _, t in rows}
    root, depth = {}, {}
    for i in range(1500):
        p = parent[i]
        root[i], depth[i] = (i, 0) if p is None else (root[p], depth[p] + 1)
    assert all((got[i].parent_turn, got[i].root_turn, got[i].depth) == (parent[i], root[i], depth[i]) for i in range(1500))
    assert [t for t, _ in sorted(got.items(), key=lambda x: x[1].reply_order)] == sorted(range(1500), key=lambda i: (root[i], i))


def test_reply_order_in_one_huge_thread(spark, monkeypatch):
    monkeypatch.setattr(quotes, "PLACES", 16)
    rows = [(9, i, "r", "> Start\nreply" if i else "Start") for i in range(200)] + [(9, 300, "x", "Other"), (9, 301, "y", "> Other\nok")]
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted(got, key=lambda r: r.reply_order)] == [*range(200), 300, 301] and {r.reply_order for r in got} == set(range(1, 203))


@pytest.mark.parametrize("places", [4, 1024])
def test_lines_of_every_message_are_looked_up_in_blocks(spark, monkeypatch, places):
    monkeypatch.setattr(quotes, "PLACES", places)
    rng = random.Random(12)
    rows, want = [], {}
    for conv in range(3):
        said = {}  # line -> latest turn that says it
        for turn in sorted(rng.sample(range(-60, 400), 120)):
            own = ["Me too.", *rng.sample([f"Line {i}" for i in range(30)], 2)]
            asked = rng.choice(["Me too."] * 2 + [f"Line {i}" for i in range(34)])
            rows.append((conv, turn, "u", "\n".join([f"> {asked}", *own])))
            want[conv, turn] = said.get(asked)
            said |= dict.fromkeys(own, turn)
    frame = spark.createDataFrame([*rows, *rows[50:60]], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.turn): r.parent_turn for r in quotes.link_quotations(frame).collect()} == want
