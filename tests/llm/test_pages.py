"""Archives, URL filter and WebP against brute force and hand-made streams."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyarrow import fs

from airlens.llm import urlfilter, warc, webp, webp_writer
from airlens.llm.common import scratch
from tests.llm.cases import TEXTS, documents, empty, rows

PAGES = [
    (1, "http://a.example.com/en/1", "<p>x</p>", "clash"), (2, "https://B.Example.com/en/7x?q#f", "<p>x</p>", "clash"), (3, "http://example.net/de/8", None, "c"), (4, "nothing", "", "c"), (5, None, "é" * 30000, "c"),
    (6, "http://x.org/es/", "<p>x</p>", "c"), (7, "http://x.org?es/", "seven", None), (8, "ftp://n.net/de/5#y", "eight\r\n\r\nx", None), (9, "http://a.example.com/en/1", "nine", "c"), (10, "://", "<p>x</p>", "c"),
]
SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    return spark.createDataFrame([*PAGES], SCHEMA)


def test_archives_are_read_back_through_the_index(spark):
    got = {r["page_id"]: r for r in warc.archived(pages(spark)).collect()}
    newest = {}
    for i, _, h, _ in PAGES:
        newest[h or ""] = max(i, newest.get(h or "", 0))
    assert sorted(got) == [p[0] for p in PAGES]
    for i, _, h, _ in PAGES:
        raw = (h or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if newest[h or ""] == i else ("revisit", newest[h or ""]))
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([PAGES[0], PAGES[0], PAGES[8]], SCHEMA)
    assert warc.archived(twice).where("record_type = 'response'").count() == 3


def test_archives_are_plain_gzip_members_and_blocks_are_searched(spark):
    folder = scratch(spark, "test-archives")
    many = spark.createDataFrame([(i, f"http://h{i % 50}.example.com/{i}", f"page {i}", "") for i in range(2000)], SCHEMA)
    captures = warc.write_archives(many, folder)
    files = warc.write_index(captures, folder)
    system, base = fs.FileSystem.from_uri(folder)
    names = {r["file"] for r in captures.collect()}
    text = b"".join(gzip.decompress(system.open_input_stream(f"{base}/{n}", compression=None).read()) for n in names)
    assert text.count(b"WARC/1.1\r\n") == 2000
    index = warc.Index(system, base, files)
    assert len(index.captures("com,example,h7)/7", 7)) == 1 and index.captures("com,example,h7)/7", 8) == [] and index.captures("zzz", 1) == [] and index.captures("", 0) == []
    got = warc.look_up(many.where("page_id % 100 = 3"), folder, files)
    assert sorted(r["page_id"] for r in got.collect()) == list(range(3, 2000, 100))


def test_read_back_is_dealt_over_tasks(spark):
    """As many index files and lookup tasks as bytes ask for, and as run at once at least, with adaptive execution on."""
    folder = scratch(spark, "test-tasks")
    many = spark.createDataFrame([(i, f"http://h{i % 50}.example.com/{i}", f"page {i}", "") for i in range(2000)], SCHEMA)
    captures = warc.write_archives(many, folder)
    files = warc.write_index(captures, folder)
    cores = spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and len(files) == cores
    for size, want in ((0, cores), (100 * warc.READ_BYTES, 100)):
        assert warc.look_up(many, folder, files, size).rdd.getNumPartitions() == want


def test_very_long_pages(spark):
    long = "<p>" + "palabra " * 400_000
    url = "http://www.example.io/" + "x/" * 40_000
    df = spark.createDataFrame([(1, url, long, ""), (2, url, long, ""), (3, url + "y", "short", "")], SCHEMA)
    got = {r["page_id"]: r for r in warc.archived(df).collect()}
    assert got[2]["payload_bytes"] == len(long) and got[1]["refers_to"] == 2 and got[3]["record_type"] == "response"
    judged = {r["page_id"]: r for r in urlfilter.judged(df).collect()}
    assert judged[1]["score"] == judged[2]["score"] and len(judged[3]["path"]) == 80_002


def test_index_keys(spark):
    df = spark.createDataFrame([("http://WWW.Example.com:80/A?b#c",), ("x",), (None,), ("https://a.b",), ("http://a b.c/d e",)], "url string")
    assert [r[0] for r in df.select(warc.index_key(df["url"])).collect()] == ["com,example,www)/A?b#c", "x)", ")", "b,a)", "c,a%20b)/d%20e"]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for at, under, kind in urlfilter.RULES:
        if (host == at or host.endswith("." + at)) and path.startswith(under) and len(at + under) > len(best[0] or ""):
            best = (at + under, kind)
    return host, path, *best


def model_verdicts(known, every):
    """The two models and the calibration in plain Python. known: (url, accepted, aside)."""
    clean = lambda u: re.sub("[^a-z0./:?=&#_-]", "~", re.sub("[0-9]", "0", (u or "").lower()))
    count = {True: defaultdict(Counter), False: defaultdict(Counter)}
    for u, accepted, aside in known:
        if not aside:
            s = "^^^" + clean(u)
            for i in range(3, len(s)):
                for k in range(4):
                    count[accepted][s[i - k : i]][s[i]] += 1
    seen = [set(), set(), set(), set(), set()]
    contexts = set()
    for side in count.values():
        for ctx, c in side.items():
            contexts.add(ctx)
            for x in c:
                seen[len(ctx) + 1].add(ctx + x)

    def p(side, ctx, x):
        low = 1 / 38 if not ctx else p(side, ctx[1:], x)
        c = count[side].get(ctx, Counter())
        return (c[x] + urlfilter.LAMBDA * low) / (sum(c.values()) + urlfilter.LAMBDA)

    def score(u):
        s = "^^^" + clean(u)
        if len(s) == 3:
            return 0.0
        return round(sum(math.log(p(True, s[i - 3 : i], s[i])) - math.log(p(False, s[i - 3 : i], s[i])) for i in range(3, len(s))) / (len(s) - 3), 9)

    return {u: score(u) for u in every}


def test_url_filter_on_odd_rows(spark):
    got = {r["page_id"]: r for r in urlfilter.judged(pages(spark)).collect()}
    for i, u, _, _ in PAGES:
        host, path, rule, verdict = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urlfilter.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_verdict_depends_on_the_url_alone(spark, sf):
    """Rows without a page_id, and rows that repeat, are judged as any other with their URL."""
    url = "http://www.example.io/en/abc"
    real = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(None, url), (999999, url), (999999, url), (None, None), (None, "")], "page_id long, url string")
    got = urlfilter.judged(real.union(odd)).where("host = 'www.example.io' and path = '/en/abc'").collect()
    assert len(got) == 3 and len({(r["verdict"], r["score"]) for r in got}) == 1 and got[0]["score"] != 0
    assert urlfilter.judged(odd).count() == 5


def test_url_filter_equals_plain_models(spark, sf):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in table.collect()}
    from pyspark.sql import functions as F

    aside = {r["page_id"] for r in table.where(F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0).collect()}
    known = [(u, plain_rule(u)[3] == "allow", i in aside) for i, u in urls.items() if plain_rule(u)[2]]
    want = model_verdicts(known, urls.values())
    got = {r["page_id"]: r for r in urlfilter.judged(table).collect()}
    assert sorted(got) == sorted(urls)
    for i, u in urls.items():
        host, path, rule, verdict = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert abs(got[i]["score"] - want[u]) < 1e-6, u
        if verdict:
            assert got[i]["verdict"] == verdict
    free = [(got[i]["score"], got[i]["verdict"]) for i in urls if not got[i]["rule"]]
    assert max((s for s, v in free if v == "block"), default=-9) < min((s for s, v in free if v == "allow"), default=9)


class Writer:
    """Writes bits, the least significant first, and prefix codes, for hand-made streams."""

    def __init__(self):
        self.flags = []

    def put(self, value, n):
        self.flags += [value >> k & 1 for k in range(n)]

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)
        if len(symbols) == 1:
            return {symbols[0]: []}
        return {s: [k] for k, s in enumerate(sorted(symbols))}

    def normal(self, lengths, alphabet):
        """A code of these lengths, itself written with a code of length 4 for the length symbols 0 to 15."""
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for s in range(alphabet):
            self.flags += [(lengths.get(s, 0) >> k) & 1 for k in (3, 2, 1, 0)]
        code, last, out = 0, 0, {}
        for n, s in sorted((n, s) for s, n in lengths.items()):
            code <<= n - last
            last = n
            out[s] = [code >> k & 1 for k in reversed(range(n))]
            code += 1
        return out

    def plane(self, argb, main=False):
        """An entropy-coded image without cache or meta codes, eight bits a channel."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        codes = [self.normal(dict.fromkeys(range(256), 8), 280), *(self.normal(dict.fromkeys(range(256), 8), 256) for _ in range(3))]
        self.simple(0)
        for v in argb:
            for code, shift in zip(codes, (8, 16, 0, 24)):
                self.flags += code[int(v) >> shift & 255]

    def start(self, width, height):
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def file(self):
        data = b"\x2f" + np.packbits(np.asarray(self.flags, np.uint8), bitorder="little").tobytes()
        return b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)


def argb_of(image):
    c = image.astype(np.uint32)
    return (c[:, :, 3] << 24 | c[:, :, 0] << 16 | c[:, :, 1] << 8 | c[:, :, 2]).ravel()


def noise(width, height, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)


def test_subtract_green():
    want = noise(7, 5)
    green = want >> 8 & 0xFF
    coded = (want & 0xFF00FF00) | (((want >> 16) - green & 0xFF) << 16) | ((want - green) & 0xFF)
    w = Writer()
    w.start(7, 5)
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    w.plane(coded, True)
    assert (argb_of(webp.decode(w.file())) == want).all()


def _avg(a, b):
    return [(x + y) // 2 for x, y in zip(a, b)]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    """Residuals are made from the original pixels by the format's rules, written anew here."""
    width, height = 6, 5
    want = webp.channels(noise(width, height, mode)).tolist()
    at = lambda y, x: want[y * width + x]
    rest = []
    for y in range(height):
        for x in range(width):
            if not y and not x:
                p = [255, 0, 0, 0]
            elif not y:
                p = at(0, x - 1)
            elif not x:
                p = at(y - 1, 0)
            else:
                left, top, corner, right = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), want[(y - 1) * width + x + 1]
                clamp = lambda v: [max(0, min(255, k)) for k in v]
                half = [m + (abs(m - c) // 2) * (1 if m >= c else -1) for m, c in zip(_avg(left, top), corner)]
                select = left if sum(abs(t - c) for t, c in zip(top, corner)) < sum(abs(k - c) for k, c in zip(left, corner)) else top
                p = [
                    [255, 0, 0, 0], left, top, right, corner, _avg(_avg(left, right), top), _avg(left, corner), _avg(left, top), _avg(corner, top), _avg(top, right),
                    _avg(_avg(left, corner), _avg(top, right)), select, clamp([a + b - c for a, b, c in zip(left, top, corner)]), clamp(half),
                ][mode]
            rest.append([(a - b) & 255 for a, b in zip(at(y, x), p)])
    w = Writer()
    w.start(width, height)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)  # tiles of four
    w.plane([mode << 8] * 4)
    w.put(0, 1)
    w.plane(webp.numbers(np.asarray(rest)), True)
    assert (argb_of(webp.decode(w.file())) == webp.numbers(np.asarray(want))).all()


def test_cross_colour():
    width, height = 5, 6
    want = webp.channels(noise(width, height, 9))
    signed = lambda v: v - 256 if v > 127 else v
    factors = [(3, 250, 17), (200, 5, 90), (0, 0, 0), (128, 127, 255)]  # green to red, green to blue, red to blue by tile
    coded = want.copy()
    for i, (a, r, g, b) in enumerate(want.tolist()):
        y, x = divmod(i, width)
        f = factors[(y >> 2) * 2 + (x >> 2)]
        coded[i, 1] = (r - (signed(f[0]) * signed(g) >> 5)) & 255
        coded[i, 3] = (b - (signed(f[1]) * signed(g) >> 5) - (signed(f[2]) * signed(r) >> 5)) & 255
    w = Writer()
    w.start(width, height)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    w.plane([f[2] << 16 | f[1] << 8 | f[0] for f in factors])
    w.put(0, 1)
    w.plane(webp.numbers(coded), True)
    assert (argb_of(webp.decode(w.file())) == webp.numbers(want)).all()


@pytest.mark.parametrize("colours", [2, 3, 4, 9, 16, 17, 200])
def test_palette_with_bundling(colours):
    width, height = 11, 4
    table = noise(colours, 1, colours)
    index = np.random.default_rng(1).integers(0, colours, (height, width))
    c = webp.channels(table)
    delta = webp.numbers(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)))
    shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    size = 8 >> shift
    packed = np.zeros((height, -(-width >> shift)), np.int64)
    for y in range(height):
        for x in range(width):
            packed[y, x >> shift] |= int(index[y, x]) << (size * (x & ((1 << shift) - 1)))
    w = Writer()
    w.start(width, height)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    w.plane(delta)
    w.put(0, 1)
    w.plane(packed.ravel() << 8, True)
    assert (argb_of(webp.decode(w.file())) == table[index.ravel()]).all()


def prefix(value):
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def test_references_cache_and_uneven_codes():
    """Literals, near and far references and cache hits with prefix codes of uneven lengths and a colour cache."""
    width, height = 16, 8
    colours = [0xFF102030, 0x80405060, 0xFF0000FF, 0x00FF00FE]
    bits = 3
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - bits)
    out, plan, cache = [], [], {}
    rng = np.random.default_rng(4)

    def push(v):
        out.append(v)
        cache[slot(v)] = v

    while len(out) < width * height:
        kind = rng.integers(0, 4)
        if kind == 0 or not out:
            v = colours[rng.integers(0, 4)]
            plan.append(("literal", v))
            push(v)
        elif kind == 1:
            k = sorted(cache)[rng.integers(0, len(cache))]
            plan.append(("cache", k))
            push(cache[k])
        else:
            far = int(rng.integers(1, len(out) + 1)) if kind == 2 else None
            if far is None:
                code = int(rng.integers(1, 121))
                x, y = webp.NEAR[code - 1]
                far = max(1, x + y * width)
                if far > len(out):
                    continue
            else:
                code = far + 120
            n = int(min(rng.integers(1, 20), width * height - len(out)))
            plan.append(("copy", n, code))
            for _ in range(n):
                push(out[-far])
    w = Writer()
    w.start(width, height)
    w.put(0, 1)
    w.put(1, 1), w.put(bits, 4), w.put(0, 1)
    symbols = sorted({v >> 8 & 255 for v in colours} | {256 + k for k in range(24)} | {280 + k for k in range(8)})
    lengths = {s: 5 for s in symbols}
    free = 32 - len(symbols)
    for s in symbols[: max(0, -free)]:  # more than 32 symbols: the last ones in pairs under longer codes
        pass
    if len(symbols) > 32:
        extra = len(symbols) - 32
        for s in symbols[-2 * extra :]:
            lengths[s] = 6
    green = w.normal(lengths, 280 + 8)
    red, blue, alpha = (w.normal({**{v >> s & 255: 2 for v in colours}, **dict.fromkeys([k for k in range(256) if k not in {v >> s & 255 for v in colours}][: 4 - len({v >> s & 255 for v in colours})], 2)}, 256) for s in (16, 0, 24))
    distance = w.normal({**dict.fromkeys(range(24), 5), **dict.fromkeys(range(24, 32), 5)}, 40)
    for entry in plan:
        if entry[0] == "literal":
            v = entry[1]
            w.flags += green[v >> 8 & 255] + red[v >> 16 & 255] + blue[v & 255] + alpha[v >> 24]
        elif entry[0] == "cache":
            w.flags += green[280 + entry[1]]
        else:
            for value, code, base in ((entry[1], green, 256), (entry[2], distance, 0)):
                s, more, n = prefix(value)
                w.flags += code[base + s]
                w.put(more, n)
    assert argb_of(webp.decode(w.file())).tolist() == out


def test_meta_codes_by_tile():
    width, height = 8, 4
    want = [0xFF000000 | (10 if x < 4 else 20) << 8 for y in range(height) for x in range(width)]
    w = Writer()
    w.start(width, height)
    w.put(0, 1)
    w.put(0, 1), w.put(1, 1), w.put(0, 3)
    w.plane([0 << 8, 1 << 8])
    for green in (10, 20):
        w.simple(green), w.simple(0), w.simple(0), w.simple(255), w.simple(0)
    assert argb_of(webp.decode(w.file())).tolist() == want


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_webp_refuses_damage():
    good = webp_writer.encode(b"x" * 192)
    for bad in (b"", b"RIFF", good[:20] + b"\0" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)
    with pytest.raises(ValueError):
        webp_writer.encode(b"x" * 191)


@pytest.mark.parametrize("values", [1, 2, 3, 5, 64, 200, 256])
def test_stored_payloads_come_back(values):
    rng = np.random.default_rng(values)
    for n in (192, 384, 19200):
        payload = rng.integers(0, values, n).astype(np.uint8).tobytes()
        assert webp.pixels(webp_writer.store(payload))[:, :, :3].tobytes() == payload
    long = bytes(192) * 16385
    assert webp.pixels(webp_writer.store(long))[:, :, :3].tobytes() == long


@pytest.mark.parametrize("kind", ["prose", "lines", "ramp", "grey", "tied", "few", "noise"])
def test_writer_uses_what_shrinks_the_file(kind, monkeypatch):
    """References and cache hits in prose, transforms where channels or neighbours tell of each other, and all come back."""
    rng = np.random.default_rng(3)
    if kind == "prose":
        payload = " ".join(rng.choice(["the", "cat", "house", "running", "above", "de", "la"], 3000)).encode()
    elif kind == "lines":
        payload = b"All rights reserved to the owner of it. " * 60
    elif kind == "ramp":
        payload = (np.arange(192 * 40) // 3 * 5 % 256 + np.tile([0, 70, 140], 64 * 40)).astype(np.uint8).tobytes()
    elif kind == "grey":
        payload = np.repeat(rng.integers(0, 256, 64 * 40), 3).astype(np.uint8).tobytes()
    elif kind == "tied":
        green = rng.integers(0, 60, 64 * 60)
        payload = np.stack([green * 2, green, rng.integers(0, 256, 64 * 60)], axis=1).astype(np.uint8).tobytes()
    elif kind == "few":
        payload = rng.choice(rng.integers(0, 256, (3, 3)).astype(np.uint8), 64 * 30).tobytes()
    else:
        payload = rng.integers(0, 256, 192 * 30).astype(np.uint8).tobytes()
    payload = payload.ljust(-(-len(payload) // 192) * 192, b" ")
    calls = Counter()
    for name in ("_resolve", "_unpredict", "_uncross", "_unindex", "_by_position"):
        f = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, f=f, name=name: calls.update([name]) or f(*a))
    stored = webp_writer.store(payload)
    assert webp.pixels(stored)[:, :, :3].tobytes() == payload
    want = {"prose": "_resolve", "lines": "_resolve", "ramp": "_unpredict", "tied": "_uncross", "few": "_unindex"}
    assert calls[want[kind]] > 0 if kind in want else True
    assert len(stored) < {"noise": 1.05, "prose": 0.6, "lines": 0.1, "ramp": 0.1, "grey": 0.5, "tied": 0.7, "few": 0.2}[kind] * len(payload) + 200


def test_feature_by_brute_force():
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (3, 64, 4)).astype(np.uint8)
    n, means, step, bins = 3 * 64, [0, 0, 0], 0, [0] * 16
    for row in image.tolist():
        for x, p in enumerate(row):
            means = [m + v for m, v in zip(means, p)]
            bins[p[1] >> 4] += 1
            step += abs(p[1] - row[x - 1][1]) if x else 0
    assert webp.feature(image) == f"3;{','.join(str(m * 100 // n) for m in means)};{step * 100 // n};{','.join(str(b * 1000 // n) for b in bins)}"


def test_webp_digests(spark):
    got = webp.digests(documents(spark)).collect()
    assert len(got) == len(rows())
    texts = dict(TEXTS)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert webp.digests(empty(spark)).count() == 0
    stored = webp.media(documents(spark))
    arrays = {r["doc_id"]: r for r in webp.pixel_arrays(stored).collect()}
    assert len(arrays[8]["rgba"]) == arrays[8]["width"] * arrays[8]["height"] * 4 and bytes(arrays[8]["rgba"][:3]) == b"wor"


def test_pages_without_an_id_are_archived_too(spark):
    """They come back without an id, refer to a page that has one, and are responses where none has."""
    own = [(1, "http://a.com/x", "one"), (None, "http://a.com/x", "one"), (None, "http://a.com/x", "one"), (None, "http://a.com/x", "two"), (None, None, "two"), (None, None, None), (7, "http://b.com", None)]
    df = spark.createDataFrame(own, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(df).collect()), key=str)
    want = [(1, 3, "response", None), (None, 3, "revisit", 1), (None, 3, "revisit", 1), (None, 3, "response", None), (None, 3, "response", None), (None, 0, "revisit", 7), (7, 0, "response", None)]
    assert got == sorted(want, key=str)
