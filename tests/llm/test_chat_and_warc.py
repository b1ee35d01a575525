import base64
import gzip
import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievecraft.llm import chat_format as cf
from sievecraft.llm import warc

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "<|turn|>user<|text|>x<|end|>\n", "\\<|", "<\\|", "<\\\\|end|>", "<<||", "\\", "", None, "a\nb", "<|", "|>\\", "é😀<|text|>"]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    rows += [(2, i, "assistant" if i % 2 else "user", NASTY[i % len(NASTY)]) for i in range(40)]
    rows += [(3, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], f"turn {i} " * (i * 13 % 90)) for i in range(60)]
    rows += [(4, 0, "system", "only"), (4, 1, "system", "systems"), (5, 0, "assistant", "x" * 20_000), (6, None, None, None), (6, 3, "user", "t"), (6, 3, "user", "t"), (6, 3, "assistant", "t"), (None, 0, "user", "u"), (None, 1, "assistant", None)]
    return spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as window", "'y' as tokens", "'z' as formatted", "1 as before")


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    out = {}
    for c, x in by.items():
        x = [(r, t) for _, _, r, t in sorted(x)]
        loss = "".join(t for r, t in x if r == "assistant")
        out[c] = (len(x), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(64, 0), (64, 2), (200, 3), (100_000, 2)])
def test_round_trip_through_windows(turns, budget, history):
    windows = cf.format_chats(turns, budget=budget, history=history, history_tokens=40).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digests(cf.read_back(windows)).collect()}
    assert got == expected(turns.collect())
    own = defaultdict(list)
    for w in windows.collect():
        own[w.conv_id].append(w)
        roles = [p.split(cf.TEXT)[0] for p in w.formatted.split(cf.TURN)[1:]]
        assert len(roles) == w.n_masked + w.n_new
        assert w.n_tokens <= budget or w.n_new == 1 or w.window == 0 and all(r == "system" for r in roles[:-1])
    system = {c: x[0].formatted.split(cf.TURN)[1].startswith("system") for c, x in own.items()}
    assert all(w.formatted.split(cf.TURN)[1].startswith("system") for c, x in own.items() if system[c] for w in x)
    if budget == 64:
        assert max(len(x) for x in own.values()) > 5
        assert history == 0 or any(w.n_masked > 1 for x in own.values() for w in x)
    windows.unpersist()


def test_a_conversation_of_very_many_windows(spark):
    """More window starts than are gathered at a time; the spans are those of a plain walk over the turns."""
    rows = [(1, i, "assistant" if i % 2 else "user", "x" * (i * 37 % 90)) for i in range(3000)]
    windows = cf.format_chats(spark.createDataFrame(rows, TURNS), budget=64, history=2, history_tokens=20)
    got = sorted((w.window, w.n_new) for w in windows.collect())
    size = [(len(t) + 3) // 4 + 4 for *_, t in rows]
    want, base, new = [], 0, 0
    for i, n in enumerate(size):
        if base + n > 64 and i:
            want.append(new)
            fits = [k for k in range(min(2, i) + 1) if sum(size[i - k : i]) <= 20]
            history = sum(size[i - max(fits) : i])
            base, new = (history if history + n <= 64 else 0), 0
        base, new = base + n, new + 1
    want.append(new)
    assert len(want) > 2 * cf._RUN and got == list(enumerate(want))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digests(cf.read_back(windows)).collect()} == expected(spark.createDataFrame(rows, TURNS).collect())


def test_no_turns(spark):
    assert cf.digests(cf.read_back(cf.format_chats(spark.createDataFrame([], TURNS)))).count() == 0


@given(st.text(alphabet="<|\\>ab\n", max_size=30))
@settings(max_examples=200, deadline=None)
def test_escape_is_reversible(t):
    escaped = t.replace("\\", "\\\\").replace("<|", "<\\|")
    assert "<|" not in escaped and escaped.replace("<\\|", "<|").replace("\\\\", "\\") == t


def test_escape_columns(spark):
    df = spark.createDataFrame([(t,) for t in NASTY if t is not None], "t string")
    assert all(r.t == r.u and "<|" not in r.e for r in df.select("t", cf.escape(df.t).alias("e"), cf.unescape(cf.escape(df.t)).alias("u")).collect())


PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>{i % 23}</p>" * (i % 5)) for i in range(200)]
    rows += [(500, None, None), (501, "", ""), (502, "http://a b\r\nX: y", "é😀"), (503, "u", "q" * 300_000), (504, "u", "q" * 300_000), (600, "a", "dup"), (600, "b", "dup"), (600, "b", "other"), (None, "n", "dup"), (None, None, None)]
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'s' as shard", "'f' as first", "'k' as kind", "'h' as sha", "'b' as bytes")


def check_pages(rows, got, least=0):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(first.get(b, p), p)
    want, seen = [], set()
    for p, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (h or "").encode()
        response = p is None or len(b) < least or first[b] == p and (p, b) not in seen
        seen.add((p, b))
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else first[b]))
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_archives_read_back(spark, pages, tmp_path, least):
    out = f"file://{tmp_path}/w"
    files = warc.write_warc(pages, out, shard_bytes=100_000, roll_bytes=3_000, min_payload=least).collect()
    back = warc.read_warc(spark, out)
    rows = [(r.page_id, r.url, r.html) for r in pages.select("page_id", "url", "html").collect()]
    check_pages(rows, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()], least)
    assert sum(f.n_records for f in files) == len(rows) and len({f.shard for f in files}) > 1 and len(files) > len({f.shard for f in files})
    responses = sorted((r.payload for r in back.where("record_type = 'response' and page_id is not null").collect()), key=bytes)
    assert set(responses) == {(h or "").encode() for p, _, h in rows if p is not None}
    for f in files:
        data = (tmp_path / "w" / f.file).read_bytes()
        assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256
        gzip.decompress(data)
    assert not (tmp_path / "w" / "_temporary").exists()


def test_archives_are_the_same_bytes_again(spark, pages, tmp_path):
    shas = []
    for k, df in enumerate((pages, pages.repartition(7))):
        warc.write_warc(df, f"file://{tmp_path}/{k}", shard_bytes=100_000, roll_bytes=3_000)
        lines = [x for f in (tmp_path / str(k) / "manifest").glob("*.json") for x in f.read_text().splitlines()]
        shas.append(sorted((json.loads(x) for x in lines), key=lambda x: x["file"]))
    assert shas[0] == shas[1] and shas[0]


def test_shards_are_even_and_ranges(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id * id as page_id", "'u' as url", "repeat('x', 200 + cast(id % 50 as int)) as html", "1 as `a.b`")
    files = warc.write_warc(rows, f"file://{tmp_path}/w", shard_bytes=100_000, most_shards=16)
    size, span = {}, {}
    for f in files.collect():
        size[f.shard] = size.get(f.shard, 0) + f.n_records
        for data in warc._members(*warc._fs(f"file://{tmp_path}/w/{f.file}")):
            p = warc.parse_record(data)["page_id"]
            lo, hi = span.get(f.shard, (p, p))
            span[f.shard] = (min(lo, p), max(hi, p))
    assert len(size) == 16 and max(size.values()) < 2 * 4000 / 16
    ends = [span[k] for k in sorted(span)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_files_without_a_manifest_entry_are_no_part(spark, pages, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write_warc(pages, out)
    n = warc.read_warc(spark, out).count()
    (tmp_path / "w" / "part-999999-00000.warc.gz").write_bytes(b"junk")
    assert warc.read_warc(spark, out).count() == n


def test_no_pages(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    assert warc.write_warc(spark.createDataFrame([], PAGES), out).count() == 0
    assert warc.read_warc(spark, out).count() == 0
