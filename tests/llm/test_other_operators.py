"""Embeddings, media, pages and the pipeline."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from skeinlake.llm import collisions, html_tree, matroska
from skeinlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


# Embeddings


def brute(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float) != 0)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    links = {i: {j for j in good if j != i and i in good and cos(good[i], good[j])} for i, _ in rows}
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in links:
            low = min([label[i], *[label[j] for j in links[i]]])
            changed |= low < label[i]
            label[i] = low
    return {i: (len(links[i]), label[i], label[i] == i) for i, _ in rows}


@pytest.mark.parametrize("block", [8192, 40])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(collisions, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * 0.1).tolist()) for i in range(160)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, (2 * np.array(rows[0][1])).tolist()), (203, None), (204, [0.0] * 16), (205, [float("nan")] * 16), (206, [None] + [1.0] * 15), (207, [1.0] * 3), (208, [])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_duplicates(docs).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    recall = sum(got[i][0] for i in want) / sum(w[0] for w in want.values())
    assert 0.99 <= recall <= 1 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert collisions.near_duplicates(docs.limit(0)).count() == 0


def test_collision_counts_are_windows():
    """The bitmaps count at least what the windows hold, and no more than a rounding to 64 places allows."""
    rng = np.random.default_rng(1)
    points = rng.standard_normal((300, 5))
    x, y = collisions.Lines(points).often(points[:50], 0.4, 4)
    got = set(zip(x.tolist(), y.tolist(), strict=True))
    exact = {(i, j) for i in range(50) for j in range(300) if (np.abs(points[i] - points[j]) <= 0.4).sum() >= 4}
    assert exact <= got


# Media


def test_media_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 5000, 140_000):
        payload = matroska.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(payload) % 64 == 0 and payload
        stored = matroska.mux(payload)
        media = matroska.parse(stored)
        assert media.error is None and matroska.demux(stored, media) == payload
        assert [c[2] for c in media.cues] == [i for i in range(len(stored)) if stored[i : i + 4] == b"\x1f\x43\xb6\x75" and i in {c[2] for c in media.cues}]
        times = [p.time_ns for p in media.packets]
        assert times == [128_000_000 * i for i in range(len(times))]


def test_media_of_other_writers():
    """Xiph and EBML laces, block groups with references, clusters and segments of unknown size, several tracks."""
    frames = [b"a" * 300, b"b" * 10, b"c" * 260]
    xiph = bytes([2, 255, 45, 10]) + b"".join(frames)
    ebml = bytes([2]) + matroska.sized(300) + matroska.sized(10 - 300 + 8191, 2) + b"".join(frames)
    block = lambda track, ticks, flags, body: matroska.sized(track) + struct.pack(">hB", ticks, flags) + body
    group = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, block(2, -3, 0, b"zz")) + matroska.element(matroska.REFERENCE, b"\x01"))
    cluster = matroska.unsigned(matroska.TIME, 10) + matroska.element(matroska.SIMPLE, block(1, 0, 0x80 | 2, xiph)) + group + matroska.element(matroska.SIMPLE, block(1, 5, 6, ebml))
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    cluster = b"\x1f\x43\xb6\x75" + unknown + cluster
    info = matroska.element(matroska.INFO, matroska.unsigned(matroska.SCALE, 1000))
    data = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67" + unknown + info + cluster + cluster
    media = matroska.parse(data)
    assert media.error is None and [(p.track, p.size, p.key, p.cluster, p.lacing) for p in media.packets[:7]] == [(1, 300, True, 0, 1), (1, 10, True, 0, 1), (1, 260, True, 0, 1), (2, 2, False, 0, 0), (1, 300, False, 0, 3), (1, 10, False, 0, 3), (1, 260, False, 0, 3)] or media.packets[4].key
    assert len(media.packets) == 14 and media.packets[3].time_ns == 7000 and data[media.packets[3].start :][:2] == b"zz"


def test_damaged_media():
    stored = matroska.mux(bytes(range(256)) * 100)
    for bad in (None, b"", b"not media", stored[:40], stored[: len(stored) // 2]):
        assert matroska.parse(bad).error
    rng = np.random.default_rng(3)
    for _ in range(200):
        broken = bytearray(stored)
        broken[rng.integers(len(broken))] ^= int(rng.integers(1, 256))
        matroska.parse(bytes(broken))


def test_media_with_any_numbers(spark):
    """Durations, scales, times and lengths of any bytes, and files cut anywhere: packets or an error, and always a table."""
    plain = matroska.mux(matroska.padded(bytes(range(256)) * 20))
    at = plain.index(b"\x44\x89\x88") + 3
    files = [plain[:at] + struct.pack(">d", x) + plain[at + 8 :] for x in (float("nan"), float("inf"), float("-inf"), 1e308, -1.0)]
    for f in files[:4]:
        media = matroska.parse(f)
        assert media.error and matroska.demux(f, media) == matroska.demux(plain, matroska.parse(plain))
    element, unsigned = matroska.element, matroska.unsigned
    block = element(matroska.SIMPLE, matroska.sized(1) + struct.pack(">hB", 5, 0x80) + b"x")
    head = element(matroska.EBML, b"")
    rng = np.random.default_rng(9)
    for wide in (*[bytes([255]) * n for n in range(1, 12)], *[rng.bytes(8) for _ in range(40)]):
        info = element(matroska.INFO, element(matroska.SCALE, wide))
        track = element(matroska.TRACKS, element(matroska.ENTRY, element(matroska.NUMBER, wide) + element(matroska.DEFAULT_DURATION, wide) + element(matroska.AUDIO, element(matroska.RATE, wide))))
        cue = element(matroska.CUES, element(matroska.POINT, element(matroska.CUE_TIME, wide) + element(matroska.POSITIONS, element(matroska.CUE_CLUSTER, wide))))
        files += [head + element(matroska.SEGMENT, part + element(matroska.CLUSTER, time + block) + cue) for part in (b"", info, track) for time in (unsigned(matroska.TIME, 3), element(matroska.TIME, wide))]
    files += [plain[: int(n)] for n in rng.integers(0, len(plain), 60)]
    for _ in range(200):
        broken = bytearray(plain)
        for i in rng.integers(0, 400, 4):
            broken[i] = int(rng.integers(256))
        files.append(bytes(broken))
    rows = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    assert matroska.packet_table(rows, "doc_id", "media").count() == sum(len(matroska.parse(f).packets) for f in files) > 500


def test_media_rows(spark):
    rows = spark.createDataFrame([(1, "abc", 0), (2, None, 0), (3, "", 0), (3, "abc", 0), (None, "é" * 1000, 0)], "doc_id long, text string, media int")
    got = matroska.store_texts(rows)
    out = got.collect()
    assert [r["n_bytes"] for r in out] == [3, 0, 0, 3, 2000] and out[1]["payload_sha256"] == out[2]["payload_sha256"]
    assert out[0]["tail_crc32"] == zlib.crc32(b"abc" + bytes(61)) and out[0]["media_sha256"] == out[3]["media_sha256"] and out[1]["payload_bytes"] == 64
    packets = matroska.packet_table(got, "doc_id", "media")
    assert packets.count() == sum(r["n_packets"] for r in out)
    assert matroska.store_texts(rows.limit(0)).count() == 0


def walked(data: bytes) -> tuple[bytes, int]:
    """The payload of a file's simple blocks, and the greatest end of a frame, by a reader that knows no more of the format than its elements."""
    payload, furthest = b"", 0

    def number(at: int, keep: bool) -> tuple[int, int]:
        n = next(i for i in range(8) if data[at] >> 7 - i & 1) + 1
        raw = int.from_bytes(data[at : at + n], "big")
        return raw if keep else raw - (1 << 7 * n), at + n

    def walk(at: int, end: int) -> None:
        nonlocal payload, furthest
        while at < end:
            ident, at = number(at, True)
            size, at = number(at, False)
            if ident in (0x18538067, 0x1F43B675):
                walk(at, at + size)
            elif ident == 0xA3:
                lacing, body, stop = data[at + 3] >> 1 & 3, at + 4, at + size
                assert data[at] == 0x81 and lacing in (0, 2, 3)
                if lacing:
                    frames, body = data[body] + 1, body + 1
                    for i in range(frames - 1 if lacing == 3 else 0):
                        body = number(body, False)[1]
                    assert lacing == 3 or (stop - body) % frames == 0
                payload += data[body:stop]
                furthest = max(furthest, stop)
            at += size

    walk(0, len(data))
    return payload, furthest


def test_media_by_another_reader(spark):
    """What is stored, read by plain recursion, is the text and its padding; digests are of exactly that."""
    rng = np.random.default_rng(12)
    texts = ["", "a", "é" * 33, *["".join(rng.choice(list("ab é\n東"), int(n))) for n in rng.integers(0, 40_000, 12)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in matroska.store_texts(rows).collect():
        raw = texts[r["doc_id"]].encode()
        payload, furthest = walked(bytes(r["media"]))
        want = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert payload == want and furthest <= len(r["media"]) == r["media_bytes"]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), hashlib.sha256(r["media"]).hexdigest())


# Pages


def test_marginals_against_all_states():
    rng = np.random.default_rng(4)
    model = html_tree.Model(rng.normal(0, 1, html_tree.FEATURES), rng.normal(0, 1, (4, 2, 2)))
    f = html_tree.forest_of([html_tree.parse("<body><nav><p>x</p></nav><div><p>a<p>b</div></body>"), html_tree.parse("<p>one<p>two")])
    nodes, edges, z = html_tree.sum_product(model, f)
    phi = f.x @ model.unary
    for t in range(2):
        own = range(f.first[t], f.first[t + 1])
        weights = {}
        for state in np.ndindex(*[2] * len(own)):
            s = dict(zip(own, state, strict=True))
            weights[state] = np.exp(sum(phi[i] * s[i] for i in own) + sum(model.edge[f.kind[i], s[f.parent[i]], s[i]] for i in own if f.parent[i] >= 0))
        total = sum(weights.values())
        assert z[t] == pytest.approx(np.log(total))
        for k, i in enumerate(own):
            assert np.exp(nodes[i, 1]) == pytest.approx(sum(w for s, w in weights.items() if s[k]) / total)


def test_pages_held_out():
    """Node labels of pages that the model hasn't seen."""
    pages = list(html_tree.training_pages(120, seed=77))
    trees = [html_tree.parse(p, "data-y") for p in pages]
    model = html_tree.trained()
    right = total = 0
    for p, t in zip(pages, trees, strict=True):
        y = [0]
        for k in range(1, len(t.parent)):
            y.append(int(t.marks[k]) if k in t.marks else y[t.parent[k]])
        want = [text for node, text in t.runs if y[node]]
        right += html_tree.contents(model, [p])[0] == want
        total += 1
    assert right / total >= 0.9


def test_parsing():
    t = html_tree.parse('<!DOCTYPE html><p>a &amp b&nbsp;c<br>d <b>e</b>f<!-- x --><script>"</p>"</script><p>g<ul><li>h<li>i</ul><table><tr><td>j<td>k</table>l < m <p')
    assert [text for _, text in t.runs] == ["a & b c d ef", "g", "h", "i", "j", "k", "l < m"]


@pytest.mark.parametrize(
    ("page", "want"),
    [("a</>b", "ab"), ("a</ div>b", "ab"), ("a</3 x>b", "ab"), ("a<é b", "a<é b"), ("a <日本> b", "a <日本> b"), ("a < b </", "a < b </"), ("a</ b", "a"), ("a<b", "a"), ("a</b", "a")],
)
def test_text_behind_malformed_tags(page, want):
    """What no tag begins is text, what only looks like an end tag is a comment; neither ends the page."""
    assert [text for _, text in html_tree.parse(page).runs] == [want]
    whole = html_tree.parse(f"<p>{page}</p><p>rest</p>" if want != "a" else f"<p>{page}></p><p>rest</p>")
    assert whole.runs[-1][1] == "rest"


def test_page_rows(spark):
    article = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>Some text &amp; more.</p></article><footer>&copy; x</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", article, 0), (1, "u", article, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "only text", 0)], "page_id long, url string, html string, text int")
    got = html_tree.extract(rows, html_tree.trained(), blocks=True).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("Title Some text & more.", 23)] * 2 + [("", 0), ("", 0), ("only text", 9)]
    assert html_tree.extract(rows.limit(0), html_tree.trained()).count() == 0


# Registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_registered(spark, name):
    table = {"op4": "embeddings", "op9": "pages"}.get(name.split("_")[0], "documents")
    rows = Q.QUERIES[name](spark, SF)
    if not name.startswith("op5"):
        assert rows.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.schema["text"] == docs.schema["text"]
            assert 0 < out.count() <= n
            n = out.count()
            docs = corpus_pipeline.staged(out, "test")
    assert out.select("doc_id").distinct().count() == n
    assert not docs.where("text RLIKE 'AKIA[0-9A-Z]{16}'").count()


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
