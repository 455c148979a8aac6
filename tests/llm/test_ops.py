"""Extraction, packing, archives, URLs, quality, media: round trips, brute force, held-out accuracy, edge cases."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import extract, media, packing, quality, warc
from riskloom.llm.common import materialize
from riskloom.llm.trees import BoostedTrees

from .helpers import CLASHES, DOCS, docs, prose

PAGES = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(7) for c in CLASHES})


# -- HTML


@pytest.fixture(scope="module")
def model():
    return extract.trained_model()


def test_article_alone(model):
    html = """<html><head><title>T</title><style>x</style></head><body><header><div class="logo">Site</div><nav><a href=/>Home</a> <a href=/a>About us</a></nav></header>
    <div class="cookie-banner">We use cookies. <button>OK</button></div><main><article><h1>Hello &amp; world</h1><p>First   paragraph&nbsp;here.<br>Second line</p><ul><li>one<li>two</ul>
    <aside class="related"><h3>Related</h3><a href=x>foo</a></aside><div class="ad-slot">Buy now</div><p>Last paragraph with <a href=y>link</a>.</p></article>
    <section id="comments"><h3>3 comments</h3><div class="comment"><p>Nice post, I really liked it a lot.</p></div></section></main>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>A</a></li></ul></aside><form><label>Name</label><input><button>Send</button><p>Subscribe to our newsletter</p></form>
    <footer>&copy; 2024 Company.</footer><script>var x="<p>no</p>";</script><!-- <p>hidden</p> --></body></html>"""
    assert extract.main_text(html, model) == "Hello & world\nFirst paragraph here. Second line\none\ntwo\nLast paragraph with link."


def test_broken_markup(model):
    for html, text in [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p title='x>y'>a</p>", "a"), ("<p class=it's>a</p>", "a"), ("a < b &lt;c&gt;", "a < b <c>"), ("<p>a<!-- b", "a"), ("<p>a<script>b", "a"), ("</div></p>a", "a")]:
        assert extract.main_text(html, model) == text, html
    assert extract.main_text("<b>" * 30_000 + "</i>" * 30_000 + "a", model) == "a"
    long = "<div>" * 3000 + "deep" + "<p>x</p>" * 5000
    assert extract.main_text(long, model).count("x") in (0, 5000)


def test_decoding_is_the_best_consistent_labelling():
    r = random.Random(1)
    for _ in range(60):
        parent = [-1] + [r.randrange(i) for i in range(1, 9)]
        margins = np.array([r.gauss(0, 2) for _ in parent])
        value = lambda keep: sum(-np.logaddexp(0, -m) if k else -np.logaddexp(0, m) for k, m in zip(keep, margins, strict=True))  # noqa: E731,B023
        allowed = [k for k in itertools.product([False, True], repeat=9) if k[0] and all(k[parent[i]] or not k[i] for i in range(1, 9))]
        assert value(extract.decode(parent, margins)) == pytest.approx(max(map(value, allowed)))


def test_trees_learn_an_interaction():
    x = np.random.default_rng(0).normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(rounds=60).fit(x[:2000], y[:2000])
    assert ((m.margins(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_held_out_pages(model):
    r = random.Random(4242)
    right = total = 0
    for _ in range(60):
        page, wanted = extract._training_page(r)
        kept = extract.decode(page.parent, model.margins(extract.node_features(page)))
        right += sum(kept[n] == bool(wanted[n]) for n, _ in page.blocks)
        total += len(page.blocks)
    assert right / total > 0.98


def test_extract_rows(spark, model):
    rows = [(1, "u", "<article><h1>A</h1><p>b c</p></article>"), (None, None, None), (2**60 + 1, "v", ""), (1, "u", "<article><h1>A</h1><p>b c</p></article>")]
    got = [tuple(x) for x in extract.extract_main_text(pages(spark, rows), model=model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", "A\nb c", 5), (None, None, "", 0), (2**60 + 1, "v", "", 0), (1, "u", "A\nb c", 5)], key=repr)
    assert extract.extract_main_text(spark.createDataFrame([], PAGES), model=model).collect() == []


# -- Packing


def naive_best_fit(lengths, sizes, opened):
    bins, out = [], []
    for n in lengths:
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            k = min(fits, key=lambda k: (bins[k], k))
        else:
            bins.append(min(s for s in sizes if s >= max(n, opened)))
            k = len(bins) - 1
        bins[k] -= n
        out.append(k)
    return out


def naive_least_cost(lengths, sizes, overhead):
    """The sizes opened by trying each on the list of pieces still to come."""

    def open_size(i, n):
        def rate(size):
            used = n
            for m in lengths[i + 1 :]:
                used += m if used + m <= size else 0
            return (min(s for s in sizes if s >= used) + overhead) / used

        return min((s for s in sizes if s >= n), key=lambda s: (round(rate(s), 9), -s))

    return open_size


def test_best_fit_against_scan():
    r = random.Random(2)
    for _ in range(80):
        sizes = sorted(r.sample(range(4, 60), 3))
        lengths = sorted((r.randint(1, sizes[-1]) for _ in range(r.randint(0, 50))), reverse=True)
        for opened in sizes:
            assert packing.best_fit(lengths, lambda i, n, o=opened: min(s for s in sizes if s >= max(n, o))) == naive_best_fit(lengths, sizes, opened)
        if lengths:
            assert packing.best_fit(lengths, packing.LeastCost(lengths, sizes, 3)) == packing.best_fit(lengths, naive_least_cost(lengths, sizes, 3))
        at, final, cost = packing.pack_group(lengths, sizes, 3)
        used = np.bincount(at, weights=lengths) if at else []
        assert all(min(s for s in sizes if s >= u) == f for u, f in zip(used, final, strict=True))
        costs = []
        for opened in sizes:
            u = np.bincount(b, weights=lengths) if (b := naive_best_fit(lengths, sizes, opened)) else []
            costs.append(sum(min(s for s in sizes if s >= x) + 3 for x in u))
        assert cost <= min(costs)


def cheapest(lengths, sizes, overhead):
    """The least cost over all ways to put few pieces into bins."""
    least = [0] + [None] * (2 ** len(lengths) - 1)
    price = {}
    for mask in range(1, 2 ** len(lengths)):
        used = sum(n for k, n in enumerate(lengths) if mask >> k & 1)
        price[mask] = min((s for s in sizes if s >= used), default=10**9) + overhead
    for mask in range(1, 2 ** len(lengths)):
        sub, best = mask, 10**9
        while sub:
            best = min(best, price[sub] + least[mask ^ sub])
            sub = (sub - 1) & mask
        least[mask] = best
    return least[-1]


def test_packing_against_all_partitions():
    r = random.Random(12)
    costs = []
    for _ in range(200):
        sizes = sorted(r.sample(range(8, 64), 4))
        lengths = sorted((r.randint(1, sizes[-1]) for _ in range(7)), reverse=True)
        costs.append((packing.pack_group(lengths, sizes, 2)[2], cheapest(lengths, sizes, 2)))
    assert all(got >= least for got, least in costs)
    assert sum(got for got, _ in costs) / sum(least for _, least in costs) < 1.005  # stated in the README
    assert sum(got == least for got, least in costs) >= 180


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, prose(i, r.choice([1, 3, 20, 64, 65, 200]))) for i in range(300)] + [(None, "a b"), (7, "a b c"), (7, "a b c"), (900, ""), (901, None), (902, " \n")]
    got = [x.asDict() for x in packing.pack(docs(spark, rows), sizes=(16, 32, 64), overhead=2, group_pieces=50).collect()]
    filled = [x for x in got if x["length"]]
    assert sum(x["length"] for x in filled) == sum(len((t or "").split()) for _, t in rows)
    assert sorted((x["doc_id"] for x in got if not x["length"]), key=repr) == [900, 901, 902] and all(x["bin_id"] is None for x in got if not x["length"])
    bins = {}
    for x in filled:
        bins.setdefault(x["bin_id"], []).append(x)
    for b in bins.values():
        b.sort(key=lambda x: x["offset"])
        ends = list(itertools.accumulate(x["length"] for x in b))
        assert [x["offset"] for x in b] == [0, *ends[:-1]] and {x["bin_used"] for x in b} == {ends[-1]}
        assert {x["bin_size"] for x in b} == {min(s for s in (16, 32, 64) if s >= ends[-1])}
    assert len({x["bin_id"] >> 32 for x in filled}) > 3
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs(spark, rows), sizes=())


def test_pack_deals_rows_of_one_id(spark):
    """Rows without an id, with one id or repeated whole are dealt to all groups, alike for every layout of the table."""
    rows = [(None, prose(i, 3)) for i in range(300)] + [(None, "a b c")] * 300 + [(7, prose(i, 3)) for i in range(300)]
    df = docs(spark, rows)
    key = lambda x: repr(sorted(x.asDict().items()))
    got, again = (sorted(packing.pack(d, sizes=(16, 32), group_pieces=90).collect(), key=key) for d in (df, df.orderBy(F.desc("text")).repartition(3)))
    assert got == again and sum(x["length"] for x in got) == 2700
    sizes = [sum(1 for x in got if x["bin_id"] >> 32 == g) for g in {x["bin_id"] >> 32 for x in got}]
    assert len(sizes) == 10 and max(sizes) < 150


# -- WARC


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, "http://c/\r\nX: y", "sämë 漢"), (8, None, None), (7, "http://d/", ""), (3, "http://b/", "same"), (None, "http://e/", "same"), (2**60 + 1, "http://f/", "x" * 700_000), (None, "g", "own")]
    got = [tuple(x) for x in warc.archive_pages(pages(spark, rows)).collect()]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, u, h in rows:
        b = (h or "").encode()
        to = first.get(h or "")
        to = None if to == i else to
        expected.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []
    small = {x["page_id"]: x["record_type"] for x in warc.archive_pages(pages(spark, rows), min_bytes=5).collect()}
    assert small[5] == "response" and small[8] == "response"


def test_seekable_bundle_and_lookup(spark):
    writer = warc.BundleWriter(frame_bytes=2000)
    records = [(f"r{i}", warc.make_record(str(i), f"http://x/{i}", prose(i, 40).encode(), 0, "D", None, "2024-01-01T00:00:00Z")) for i in range(50)]
    for name, r in records:
        writer.add(name, r)
    bundle = writer.close()
    table = warc.seek_table(bundle)
    assert len(table) > 5
    for (name, r), (n, frame, offset, length) in zip(records, writer.index, strict=True):
        assert n == name and warc.read_frame(bundle, table[frame])[offset : offset + length] == r
    damaged = bytearray(bundle)
    damaged[table[2][0] + 30] ^= 1
    with pytest.raises(Exception):
        warc.read_frame(bytes(damaged), table[2])
    archives = materialize(warc.write_archives(pages(spark, [(i, f"http://x/{i}", prose(i, 90)) for i in range(120)]), frame_bytes=3000, bundle_bytes=6000), "archives")
    assert archives.count() > 4
    digest = base64.b32encode(hashlib.sha1(prose(77, 90).encode()).digest()).decode()
    wanted = spark.createDataFrame([(warc.record_id("77", digest),), ("urn:uuid:none",)], "record_id string")
    assert [(x["page_id"], x["payload_digest"]) for x in warc.find_records(archives, wanted).collect()] == [(77, digest)]
    assert sorted(x["page_id"] for x in warc.read_archives(archives).collect()) == list(range(120))
    for broken in ("slice(index, 2, size(index))", "transform(index, x -> named_struct('record_id', 'r', 'frame', x.frame, 'offset', x.offset, 'length', x.length))", "concat(index, slice(index, 1, 1))"):
        with pytest.raises(Exception, match="index"):
            warc.read_archives(archives.withColumn("index", F.expr(broken))).collect()


# -- Quality


def test_quality_held_out(spark):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(1500):
        good = r.random() < 0.75
        text = prose(i, r.randint(20, 120)).capitalize() + "."
        bad = r.choice([lambda: text.upper().replace(" ", "!! "), lambda: " | ".join(text.split()), lambda: " ".join(w for x in text.split() for w in [x] * 9)])
        rows.append((i, text if good else bad()))
        if r.random() < 0.6:
            marks.append((i, int(good)))
    marks += [(3, 0), (3, 1), (None, 1)]
    truth = dict(marks)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int").withColumn("text", F.lit("x"))
    rows += [(None, "some text"), (2000, ""), (2001, None), (2002, "a"), (2002, "a")]
    got = quality.score_quality(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth and x["doc_id"] != 3]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.95


def test_held_out_labels_are_not_learnt(spark):
    rows = [(i, prose(i, 30)) for i in range(300)]
    flip = lambda wrong: spark.createDataFrame([(i, (i % 3 > 0) ^ (wrong and zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(200)], "doc_id bigint, quality boolean").withColumn("quality", F.col("quality").cast("int"))
    a, b = ({x["doc_id"]: x["score"] for x in quality.score_quality(docs(spark, rows), flip(w)).collect()} for w in (False, True))
    assert a == b


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_is_estimated_without_negatives(share):
    """Classes that overlap: the estimate is near the share and errs upwards, as what can't be told apart counts as positive."""
    draw = np.random.default_rng(3)
    p, n = draw.normal(0.9, 1, (6000, 28)), draw.normal(-0.6, 1, (6000, 28))
    u = np.vstack([p[: int(3000 * share)], n[: 3000 - int(3000 * share)]])
    assert quality.estimate_prior(p[3000:], draw.permutation(u), u.mean(0), u.std(0)) == pytest.approx(share, abs=0.04)


def test_quality_of_ids_that_repeat(spark):
    """Which text of an id is learnt from doesn't depend on the order of rows."""
    rows = [(i, prose(i, 30)) for i in range(200)] + [(i, prose(i + 500, 9).upper()) for i in range(200)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1, 0)], "doc_id bigint, quality int")
    a, b = (sorted((x["doc_id"], x["text_hash"], x["score"]) for x in quality.score_quality(docs(spark, r), labels).collect()) for r in (rows, rows[::-1]))
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-6)


def test_quality_without_data(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score_quality(spark.createDataFrame([], DOCS), none).collect() == []
    assert {x["score"] for x in quality.score_quality(docs(spark, [(1, "a"), (2, "b")]), none).collect()} == {0.5}


def test_risk_never_negative_branch():
    """With far too large a prior the plain unbiased risk is negative; the fit must still separate."""
    draw = np.random.default_rng(3)
    p, n = draw.normal(2, 1, (400, 28)), draw.normal(-2, 1, (400, 28))
    u = np.vstack([p[:150], n[:150]])
    s = quality.Scorer(u.mean(0), u.std(0)).fit(p[150:], u, 0.5)
    assert s.scores(p[:150]).mean() > 0.8 and s.scores(n[150:]).mean() < 0.2


# -- Media


def plain_unfilter(rows, kinds):
    """Sample by sample, as the format defines it."""
    out = [[0] * rows.shape[1] for _ in rows]
    for y, (row, kind) in enumerate(zip(rows.tolist(), kinds, strict=True)):
        for x, v in enumerate(row):
            a, b = out[y][x - 1] if x else 0, out[y - 1][x] if y else 0
            c = out[y - 1][x - 1] if x and y else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y][x] = (v + (0, a, b, (a + b) // 2, nearest)[kind]) & 255
    return np.array(out, np.uint8)


@pytest.mark.parametrize("kind", [*range(5), None])
def test_png_filters(kind):
    draw = np.random.default_rng(kind or 9)
    payloads = [(draw.integers(0, 256, n * media.WIDTH, np.uint8) if n % 2 else np.repeat(draw.integers(97, 123, n, np.uint8), media.WIDTH)).tobytes() for n in (1, 2, 9, 300)]
    images = media.encode_images(payloads, kind)
    assert [x.tobytes() for x in media.decode_images(images)] == payloads
    used = {int(k) for m in images for k in media.read_png(m)[:, 0]}
    assert used == {kind} if kind is not None else len(used) > 1


def test_unfiltering_against_the_definition():
    draw = np.random.default_rng(4)
    for heights in ([1], [20], [3, 1, 1, 40, 7]):
        n = sum(heights)
        first, kinds = media._firsts(heights), draw.integers(0, 5, n)
        rows = draw.integers(0, 256, (n, 17), np.uint8)
        expected = np.vstack([plain_unfilter(r, k) for r, k in zip(np.split(rows, np.cumsum(heights)[:-1]), np.split(kinds, np.cumsum(heights)[:-1]), strict=True)])
        assert (media.unfilter_rows(rows, first, kinds) == expected).all()
        assert (media.filter_rows(expected, first, kinds)[1] == rows).all()


def test_png_damage():
    (good,) = media.encode_images([bytes(640)])
    for at in (0, 20, 45, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 255
        with pytest.raises(ValueError):
            media.decode_images([bytes(bad)])
    with pytest.raises(ValueError):
        media.decode_images([good[:-12]])


def test_cosine_hash_against_the_direct_transform():
    draw = np.random.default_rng(6)
    for height in (1, 5, 32, 64, 100):
        image = draw.integers(0, 256, (height, 64), np.uint8)
        small = np.zeros((32, 32))
        for y in range(32):  # means over the exact area of each cell
            lo, hi = y * height / 32, (y + 1) * height / 32
            weights = np.array([max(0.0, min(hi, r + 1) - max(lo, r)) for r in range(height)])
            small[y] = (weights @ image / weights.sum()).reshape(32, 2).mean(axis=1)
        direct = [[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        c = np.array(direct).ravel().round(6)  # noise about zero is no coefficient
        over = [v > np.median(c[1:]) for v in c]
        assert media.cosine_hash(image) == f"{int(''.join(str(int(b)) for b in over), 2):016x}"


def test_media_rows(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é" * 64), (None, "abc"), (2**60 + 1, prose(1, 30_000)), (1, "abc")]
    got = media.media_columns(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        x = by[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[None]["feature"] == by[1]["feature"] and by[2]["media_sha256"] == by[3]["media_sha256"] and len(by[4]["feature"]) == 16
    assert media.media_columns(spark.createDataFrame([], DOCS)).collect() == []


def test_cosine_hash_is_stable_and_tells_apart():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 256, (40, 64), np.uint8)
    b = a.copy()
    b[3, 5] ^= 1
    bits = lambda x: np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))
    assert (bits(media.cosine_hash(a)) != bits(media.cosine_hash(b))).sum() <= 2
    assert (bits(media.cosine_hash(a)) != bits(media.cosine_hash(draw.integers(0, 256, (40, 64), np.uint8)))).sum() > 12


def test_pages_by_hand(model):
    """Pages that share no words with the generator: parts of an article named like readers' talk, talk named like a part, notices without a label, cookies to eat."""
    paper = """<article><h1>Title of it</h1><section class='intro'><h2>Introduction</h2><p>We study the thing in depth, and it is large.</p></section><section class='discussion'><h2>Discussion</h2>
    <p>Our results show that the thing is larger than was known before, which matters for all.</p><p>Further work is needed, as ever.</p></section></article>"""
    talk = """<article><h1>Title of it</h1><p>We study the thing in depth, and it is large.</p><p>More of it, with words.</p></article>
    <section class='discussion'><h3>3 comments</h3><div class='comment'><p>Nice post!</p></div><div class='comment'><p>I don't agree with that at all.</p></div></section>"""
    notice = "<p>We use cookies to make this site better.</p><h1>Title of it</h1><p>We study the thing in depth, and it is large.</p><p>More of it, with words, that say a lot about it.</p>"
    baking = "<article><h1>How to bake</h1><p>Bake the cookies for ten minutes until they are golden, then let them cool.</p><p>They keep for a week.</p></article>"
    table = "<article><h1>Results</h1><p>The table shows the numbers of each year.</p><table><tr><td>2020</td><td>15 percent</td></tr><tr><td>2021</td><td>17 percent</td></tr></table><p>They grow.</p></article>"
    text = lambda body: extract.main_text(f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{body}<footer>&copy; 2024</footer></body></html>", model).split("\n")
    assert text(paper) == ["Title of it", "Introduction", "We study the thing in depth, and it is large.", "Discussion", "Our results show that the thing is larger than was known before, which matters for all.", "Further work is needed, as ever."]
    assert text(talk) == ["Title of it", "We study the thing in depth, and it is large.", "More of it, with words."]
    assert text(notice) == ["Title of it", "We study the thing in depth, and it is large.", "More of it, with words, that say a lot about it."]
    assert text(baking) == ["How to bake", "Bake the cookies for ten minutes until they are golden, then let them cool.", "They keep for a week."]
    assert text(table) == ["Results", "The table shows the numbers of each year.", "2020", "15 percent", "2021", "17 percent", "They grow."]


@pytest.mark.parametrize(("prior", "negative"), [(0.3, False), (0.95, True)])
def test_risk_and_gradient_against_finite_differences(monkeypatch, prior, negative):
    """One step moves every weight against the slope of what the risk's definition says is followed; both branches."""
    monkeypatch.setattr(quality, "_STEPS", 1)
    monkeypatch.setattr(quality, "_BATCH", 64)
    draw = np.random.default_rng(2)
    p, u = draw.normal(0.8, 1, (300, 28)), draw.normal(-1.5 if negative else 0, 1, (300, 28))
    scorer = quality.Scorer(np.zeros(28), np.ones(28))
    if negative:  # positives that are told well, and would cost much as negatives
        scorer.w[4] = draw.normal(0.4, 0.2, 28)
    before = [w.copy() for w in scorer.w]
    rows = np.random.default_rng(11)
    zp, zu = (z[rows.integers(0, 300, 64)] for z in (p, u))

    def margins(w, z):
        return np.tanh(z @ w[0] + w[1]) @ w[2] + w[3] + z @ w[4]

    def parts(w):
        gp, gu = margins(w, zp), margins(w, zu)
        return prior * np.log1p(np.exp(-gp)).mean(), np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()

    def followed(w):
        plus, minus = parts(w)
        return (plus + minus if minus >= 0 else -minus) + sum(quality._DECAY * (x**2).sum() / 2 for i, x in enumerate(w) if i != 3)

    assert (parts(before)[1] < 0) == negative
    scorer.fit(p, u, prior)
    checked = 0
    for i, w in enumerate(before):
        for at in np.ndindex(w.shape):
            slopes = []
            for e in (1e-5, -1e-5):
                moved = [x.copy() for x in before]
                moved[i][at] += e
                slopes.append(followed(moved))
            slope = (slopes[0] - slopes[1]) / 2e-5
            if abs(slope) > 1e-6:
                assert np.sign(before[i][at] - scorer.w[i][at]) == np.sign(slope), (i, at)
                checked += 1
    assert checked > 300
