"""Each operator against brute force or an exact round trip, and its edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import op1_sharding, op2_simhash, op3_digest, op4_toxicity, op5_mixing, op6_packing, op7_html, op8_exact_dedup, op9_token_files, op10_chat, queries
from quillspan.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
EDGES = [
    (1, "a b c d", "en", "s1", 7),
    (2, None, None, None, None),
    (3, "", "en", "s2", 0),
    (4, " \t\n", "en", "s2", 3),
    (5, "a  b\tc\nd", "en", "s1", 8),
    (5, "a b c d", "en", None, 7),
    (6, "word " * 6000, "en", "s3", 30000),
    (7, "word " * 6000, "en", "s1", 30000),
    (7, "word " * 6000, "en", "s1", 30000),
    (None, "lost <|endoftext|> id", "en", "s3", 21),
    (-8, "Straße\x1c ÀÉ 漢字 don't  I'll\n\n x", "de", "s3", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({"size": F.lit("x"), "score": F.lit("y"), "bucket": F.lit(1), "kept": F.lit(0), "key": F.lit("k"), "target": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def oracle(name, frames):
    con = duckdb.connect()
    for k, df in frames.items():
        pdf = df.toPandas()
        con.register(k, pdf)
    return con.execute(queries.oracle_sql()[name]).fetch_df() if hasattr(con, "fetch_df") else con.execute(queries.oracle_sql()[name]).df()


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op1_sharding.shard_documents(nothing).count() == 0
    assert op2_simhash.near_duplicates(nothing).count() == 0
    assert op3_digest.document_digests(nothing).count() == 0
    assert op4_toxicity.toxicity(nothing, labels).count() == 0
    assert op5_mixing.mix(nothing).count() == 0
    assert op5_mixing.mixed_rows(nothing).count() == 0
    assert op6_packing.pack_documents(nothing).count() == 0
    assert op8_exact_dedup.exact_duplicates(nothing).count() == 0
    assert op8_exact_dedup.keep_first(nothing).count() == 0
    assert op9_token_files.token_files(nothing).count() == 0
    assert op7_html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert op10_chat.render_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 1 sharding


def _check_shards(found, source):
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in source)
    size, slots = Counter(), defaultdict(list)
    for r in found:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_op1_law(docs):
    _check_shards(rows(op1_sharding.shard_documents(docs, bin_groups=20, fan=4)), rows(docs))
    found, source = rows(op1_sharding.shard_documents(docs)), rows(docs)
    size = _check_shards(found, source)
    assert set(size) == set(range(16))
    by = defaultdict(set)
    text = {r["doc_id"]: r["text"] for r in source}
    for r in found:
        by[text[r["doc_id"]]].add(r["shard"])
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]].encode()) + 1
    assert all(len(v) == 1 for v in by.values())
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 16


def test_op1_edges(edges):
    found = rows(op1_sharding.shard_documents(edges))
    _check_shards(found, [dict(doc_id=e[0]) for e in EDGES])
    assert {r["size"] for r in found if r["doc_id"] in (2, 3)} == {1}


def test_differencing_beats_greedy():
    sizes = np.array([8, 7, 6, 5, 4] + [1] * 3)
    v = np.zeros((len(sizes), 2), np.int64)
    v[:, 0] = sizes
    slot = op1_sharding.difference(v)[:, 0]
    sums = [int(sizes[slot == k].sum()) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) <= 1


# 2 near-dedup


def _plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", t)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps):
    names, parent = list(fps), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            if (fps[names[i]] ^ fps[names[j]]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, n in enumerate(names):
        groups[find(i)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


def test_op2_brute_force(docs):
    fps = {r["doc_id"]: _plain_fingerprint(r["text"]) for r in rows(docs)}
    want = _components(fps)
    found = rows(op2_simhash.near_duplicates(docs))
    assert len(found) == len(fps)
    for r in found:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("heavy", [16_384, 12])
def test_op2_links_lose_none(spark, heavy):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {0, 1, 3, 7, 15, 2**64 - 1}
    for b in base:
        at = b
        for _ in range(40):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(bit)
            fps.add(at)
    fps = sorted(fps)
    want = _components({f: f for f in fps})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {f: f for f in fps}
    from quillspan.llm.components import connected_components

    for r in connected_components(op2_simhash.links(df, heavy)).collect():
        got[r["node"] % 2**64] = r["component"] % 2**64
    assert len(set(got.values())) == len(set(want.values()))
    assert {frozenset(f for f in fps if got[f] == c) for c in set(got.values())} == {frozenset(f for f in fps if want[f] == c) for c in set(want.values())}


def test_op2_edges(edges):
    found = rows(op2_simhash.near_duplicates(edges))
    assert len(found) == len(EDGES)
    zero = [r for r in found if r["doc_id"] in (2, 3, 4)]
    assert {r["fingerprint"] for r in zero} == {"0" * 16} and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in found if r["doc_id"] in (6, 7)} == {6}


# 3 digests


def _plain_digest(data):
    counts = [0] * 256
    for i in range(len(data)):
        for salt, (p, q) in enumerate([(1, 2), (1, 3), (2, 3)]):
            if i + q < len(data):
                x = data[i] * 0x9E3779B1 + data[i + p] * 0x85EBCA77 + data[i + q] * 0xC2B2AE3D + 0x27D4EB2F * (salt + 1)
                counts[(x * 0x165667B1 & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(counts)
    codes = [sum(c > ranked[k] for k in (63, 127, 191)) for c in counts]
    return codes, min(255, int(np.log1p(len(data)) * 12))


def _plain_likeness(a, b):
    apart = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(a[0], b[0])) + abs(a[1] - b[1])
    return 1.0 if a == b else max(0.0, 1 - apart / (1.625 * 256))


def test_op3_against_plain(docs):
    source = sorted(rows(docs), key=lambda r: r["doc_id"])[:60]
    found = {r["doc_id"]: r for r in rows(op3_digest.document_digests(docs.where(F.col("doc_id") <= source[-1]["doc_id"])))}
    prints = [_plain_digest(r["text"].encode()) for r in source]
    for i, r in enumerate(source):
        t, j = r["text"], (i + 1) % len(source)
        edited = _plain_digest((t[: len(t) - len(t) // 2] + source[j]["text"][: len(t) // 2]).encode())
        codes, size = prints[i]
        f = found[r["doc_id"]]
        assert f["fingerprint"] == bytes(sum(codes[4 * k + m] << 2 * m for m in range(4)) for k in range(64)).hex() + f"{size:02x}"
        assert f["near_edited"] == pytest.approx(_plain_likeness(prints[i], edited)) and f["near_next"] == pytest.approx(_plain_likeness(prints[i], prints[j]))


def test_op3_whole(docs):
    source = sorted(rows(docs), key=lambda r: r["doc_id"])
    found = {r["doc_id"]: r for r in rows(op3_digest.document_digests(docs))}
    assert len(found) == len(source)
    for i, r in enumerate(source):
        t, nxt = r["text"], source[(i + 1) % len(source)]["text"]
        n, f = len(t), found[r["doc_id"]]
        edited = t[: n - n // 2] + nxt[: n // 2]
        assert f["n_chars"] == n and f["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert f["fingerprint"] == op3_digest.digest(t.encode()).hex() and f["near_next"] == op3_digest.likeness(op3_digest.digest(t.encode()), op3_digest.digest(nxt.encode()))
        assert 0 <= f["near_edited"] <= 1
    long = [r for r in found.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


def test_op3_edges(edges):
    found = rows(op3_digest.document_digests(edges))
    assert Counter(r["doc_id"] for r in found) == Counter(e[0] for e in EDGES)
    edited = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    by = defaultdict(list)
    for e in EDGES:
        by[e[0]].append(e[1] or "")
    for i, nxt in ((None, -8), (-8, 1), (1, 2), (2, 3), (3, 4)):
        assert next(r for r in found if r["doc_id"] == i)["edited_sha256"] == edited(by[i][0], by[nxt][0])
    assert next(r for r in found if r["doc_id"] == 4)["edited_sha256"] in {edited(by[4][0], t) for t in by[5]}
    same = [r["fingerprint"] for r in found if r["doc_id"] in (6, 7)]
    assert len(set(same)) == 1
    assert next(r for r in found if r["doc_id"] is None)["near_next"] >= 0


def test_op3_single(spark):
    r = rows(op3_digest.document_digests(spark.createDataFrame([(1, "abcd", "", "", 4)], SCHEMA)))
    assert r[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r[0]["near_next"] == 1.0


# 4 toxicity


def test_op4_held_out(spark):
    d = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = op4_toxicity.toxicity(docs, known).join(known, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = found[found.toxic == 1].score.to_numpy(), found[found.toxic == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert auc > 0.85 and (found.predicted == found.toxic).mean() > 0.87


def test_op4_edges(edges, spark):
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (7, 0, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    found = rows(op4_toxicity.toxicity(edges, labels))
    assert len(found) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


# 5 mixing


def _water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: 3 * sizes[s] for s in over}


def test_op5_targets_and_sums(edges, docs):
    for df in (docs, edges):
        found = rows(op5_mixing.mix(df))
        sizes, taken = Counter(), Counter()
        for r in found:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        want = _water(sizes)
        assert {r["source"]: r["target"] for r in found} == pytest.approx(want)
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_op5_rows_follow_plan(docs):
    plan = {r["doc_id"]: r for r in rows(op5_mixing.mix(docs))}
    words = Counter()
    source = {r["doc_id"]: r for r in rows(docs)}
    for r in rows(op5_mixing.mixed_rows(docs)):
        words[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
        assert source[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(words[i] == r["taken"] for i, r in plan.items())


# 6 packing


def _check_packing(found, source, most=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    seqs, docs_ = defaultdict(list), defaultdict(list)
    for r in found:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs_[r["doc_id"]].append(r)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= most
    for r in source:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        own = [p for p in docs_[r["doc_id"]] if p["doc_tokens"] == len(ids)]
        covered = Counter()
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            covered.update(range(p["start"], p["start"] + p["length"]))
        assert set(covered) == set(range(len(ids))) and len(set(covered.values())) == 1
    return sum(r["length"] for r in found) / (most * len(seqs))


def test_op6_pieces(docs):
    assert _check_packing(rows(op6_packing.pack_documents(docs)), rows(docs)) > 0.97


def test_op6_edges(edges):
    source = [dict(doc_id=e[0], text=e[1]) for e in EDGES if e[0] != 5]
    _check_packing(rows(op6_packing.pack_documents(edges.where("doc_id is null or doc_id <> 5"), block=3)), source)


def test_best_fit_takes_tightest_window():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 400).tolist()
    placed = op6_packing.best_fit_decreasing(lengths)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            left = min(fits) - lengths[i]
        else:
            left = 2048 - lengths[i]
        room.append(left)
        want[i] = left
    assert [2048 - o - lengths[i] for i, (_, o) in enumerate(placed)] == [want[i] for i in range(len(lengths))]


def test_op2_keep_first_leaves_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    other = " ".join(f"other{i}" for i in range(3000))
    data = [(3, text), (3, text + " x"), (None, text + " y"), (9, text + " z"), (None, other), (None, other + " x"), (None, other + " y"), (3, "quite another text")]
    prints = [op2_simhash.fingerprint(t) for _, t in data]
    assert all((prints[0] ^ p).bit_count() <= 3 for p in prints[:4]) and all((prints[4] ^ p).bit_count() <= 3 for p in prints[4:7])
    kept = rows(op2_simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string")))
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in kept) == [(0, "other"), (3, "quite"), (3, "word0")]


# 7 html


def test_op7_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>H</header><nav><ul><li><a>n</a></ul></nav>
    <div class="ad">Ad</div><div class="cookie-notice">C</div><aside>S</aside><article class="post"><header><h1>Head &amp; line</h1></header><p><b>One<br>two&nbsp;<i>three</i><p>Four <form>f<input></form> five
    <ul><li>x<li>y</ul><div class="comments"><p>bad</div></article><section id="comments"><article>reader</article></section><footer>&copy;</footer></body></html>"""
    assert op7_html.main_text(page) == "Head & line\n\nOne two three\n\nFour\n\nfive\n\nx\n\ny"
    assert op7_html.main_text(None) == "" and op7_html.main_text("plain <b>text") == "plain text" and op7_html.main_text("<div>" * 5000 + "deep") == "deep"


def test_op7_template_is_induced(spark):
    page = "<html><body><div><span>Always here</span></div><div><p>Slot {i} text</p><p>More {i}</p></div><div>Constant foot</div></body></html>"
    data = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(12)] + [(100, "http://few.example/", page.format(i=100)), (101, None, None), (102, "x", "")]
    found = {r["page_id"]: r["text"] for r in rows(op7_html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert all(found[i] == f"Slot {i} text\n\nMore {i}" for i in range(12))
    assert found[100].startswith("Always here") and found[101] == found[102] == "" and len(found) == 15


def test_op7_long_lists_and_deep_nesting():
    from quillspan.llm import dom

    rng = np.random.default_rng(7)
    kinds = ["<p>x</p>", "<p>x<b>y</b></p>", "<h2>x</h2>", "<ul><li>x</ul>", "<p><i>x</i>y<b>z</b></p>"]
    trees = []
    for n in (90, 140):
        trees.append(dom.parse("<div>" + "".join(kinds[k] for k in rng.integers(0, 5, n)) + "</div>"))
        dom.prepare(trees[-1])
    exact = dom.match_trees(*trees)
    for budget in (1, 50, 1000):
        pairs = dom.match_trees(*trees, budget)
        assert len(pairs) == len(exact) and all(x.tag == y.tag for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    short, long = (dom.parse("<h2>x</h2>" * k + "<p>x<b>y</b></p>" * 600 + "<hr>" * k) for k in (0, 900))
    dom.prepare(short), dom.prepare(long)
    assert len(dom.match_trees(short, long)) == len(dom.match_trees(long, short)) == 1 + 600 * 4
    deep = "<div>" * 3000
    page = f"{deep}<p>One<nav>menu</nav><aside>side</aside><div class='comments'><p>bad</p></div></div><p>Two{'</div>' * 2999}<p>Three"
    assert op7_html.main_text(page) == "One\n\nTwo\n\nThree"
    made = op7_html.Exemplar(page, frozenset(range(10**4)))
    assert op7_html.main_text(page.replace("Two", "Second") + "<p>Four", made) == "Second\n\nFour"


def test_op7_main_text_is_kept():
    long = "The main text of this page is this long line of words."
    teaser, article = "<article>Teaser</article>", f"<article><p>{long}</p></article>"
    for page in (f"<main><p>{long}</p>{teaser}</main>", f"<div><p>{long}</p></div>{teaser}", f"<main><p>{long}</p></main>{teaser}"):
        assert op7_html.main_text(f"<body>{page}</body>") == f"{long}\n\nTeaser"
    for name in ("has-sidebar", "no-sidebar", "page share", "left-sidebar content", "search", "widget", "notice"):
        for inner in (article, f"<p>{long}</p>", f"<main><p>{long}</p></main>"):
            assert op7_html.main_text(f"<body><div class='{name}'>{inner}<div class='comments'><article>Reader {long}</article></div></div><div class='ad'>{long} {long}</div></body>") == long
    assert op7_html.main_text(f"<div class='ads'>{long}</div>") == op7_html.main_text(f"<form>{long}</form>") == long
    assert op7_html.main_text(f"<div class='sidebar'>{long}</div>{article}") == op7_html.main_text(f"<nav>{long}</nav><p>{long}</p><div class='menu'><a>{long} {long}</a></div>") == long


@pytest.mark.parametrize("sent", [100_000, 0])
def test_op7_copies_count_once(spark, monkeypatch, sent):
    monkeypatch.setattr(op7_html, "SENT_COPIES", sent, raising=False)
    page = "<html><body><div><span>Always here</span></div><div><p>Slot {i} text</p><p>More {i}</p></div><div>Constant foot</div></body></html>"
    data = [(0, "http://same.example/", page.format(i=0))] * 7 + [(i, f"http://mirror.example/{i}", page.format(i=1)) for i in range(6)]
    data += [(i, f"http://most.example/{i}", page.format(i=i if i < 6 else 9)) for i in range(90)]
    found = rows(op7_html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")))
    assert len(found) == len(data)
    for r in found:
        i = r["page_id"]
        want = f"Slot {i if i < 6 else 9} text\n\nMore {i if i < 6 else 9}" if "most" in r["url"] else None
        n = 0 if "same" in r["url"] else 1
        assert r["text"] == (want or f"Always here\n\nSlot {n} text\n\nMore {n}\n\nConstant foot") and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("sent", [24 << 20, 0])
def test_op7_layouts(spark, monkeypatch, sent):
    monkeypatch.setattr(op7_html, "SENT_BYTES", sent)
    kinds = ["<div><span>Always here</span></div><div><p>Slot {i} text</p></div>", "<section><p>Slot {i} text</p></section><center>Other foot</center>", "<table><tr><td>Old head<td>Slot {i} text</table>"]
    data = [(i, f"http://h.example/{i}", kinds[i % 3].format(i=i)) for i in range(30)]
    data += [(100 + i, f"http://blank.example/{i}", kinds[0].format(i=100 + i) if i < 9 else ["", None, " "][i % 3]) for i in range(18)]
    found = {r["page_id"]: r["text"] for r in rows(op7_html.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert found == {i: f"Slot {i} text" if i < 109 else "" for i, *_ in data}


def test_op7_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    want = {}
    for r in rows(pages):
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = "\n\n".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body.replace("<br>", " "))) if x)
    found = {r["page_id"]: r["text"] for r in rows(op7_html.extract_text(pages))}
    assert found == want


def _article_texts(pages):
    import html

    want = {}
    for r in rows(pages):
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = "\n\n".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body.replace("<br>", " "))) if x)
    return want


def test_op7_wrapper_decides(spark):
    """Pages of hosts with five or more, without a telling element or name: menus, adverts and foot lines are plain divs, the article too."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))
    pages = pages.join(pages.groupBy("host").count().where("count >= 5").select("host"), "host")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "(?i)(</?)(?:article|nav|footer|header|aside|main|section)\\b[^>]*>", "$1div>"), "<div class=[^>]*>", "<div>"))
    want = _article_texts(pages)
    found = {r["page_id"]: r["text"] for r in rows(op7_html.extract_text(bare))}
    plain = {r["page_id"]: op7_html.main_text(r["html"]) for r in rows(bare)}
    assert len(want) > 100 and found.keys() == want.keys()
    assert sum(plain[i] == want[i] for i in want) == 0
    assert sum(found[i] == want[i] for i in want) >= 0.75 * len(want)


# 8 exact dedup


def _check_dedup(found, source):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups, kept = defaultdict(list), Counter()
    for r in source:
        groups[hashlib.sha256(norm(r["text"]).encode()).hexdigest()].append(r["doc_id"])
    assert len(found) == len(source)
    for r in found:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept) == set(groups) and set(kept.values()) == {1}


def test_op8(docs, edges):
    _check_dedup(rows(op8_exact_dedup.exact_duplicates(docs)), rows(docs))
    _check_dedup(rows(op8_exact_dedup.exact_duplicates(edges)), [dict(doc_id=e[0], text=e[1]) for e in EDGES])


def test_op8_colliding_digests(docs):
    weak = lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2))
    _check_dedup(rows(op8_exact_dedup.exact_duplicates(docs, digest=weak)), rows(docs))


def test_op8_index_merges_runs(spark):
    """Runs flushed one after another, compacted twice; the filter passes every digest in it."""
    index = op8_exact_dedup.DigestIndex(spark)
    batches = [[(i + 10 * k, f"t{(i * 7 + k) % 9}") for i in range(20)] for k in range(4)]
    frame = lambda b: spark.createDataFrame(b, "doc_id long, t string").select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"))
    every = []
    for k, b in enumerate(batches):
        index.flush(frame(b))
        every += b
        if k % 2:
            assert len(index.runs) == 2 + (k > 1)
            got = {bytes(r["digest"]): (r["least"]["doc_id"], r["rows"]) for r in index.compact().collect()}
            assert len(index.runs) == 1
            want = {hashlib.sha256(t.encode()).digest(): (min(i for i, x in every if x == t), sum(x == t for _, x in every)) for t in {t for _, t in every}}
            assert got == want
    probe = frame([(1, "t1"), (2, "t2")] + [(i, f"other{i}") for i in range(500)])
    flagged = op8_exact_dedup.Filter(index.runs[0].select("digest")).flag(probe).where("maybe").collect()
    assert {r["doc_id"] for r in flagged} >= {1, 2} and len(flagged) < 20


def test_op2_keep_first(spark):
    """One row of each component, also where rows share a doc_id or have none."""
    near = "one two three four five six seven eight nine ten "
    apart = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    made = [(3, near * 20), (5, near * 20), (5, apart * 20), (None, near * 20), (9, None), (None, ""), (None, "quite another text than all of these others here")]
    kept = op2_simhash.keep_first(spark.createDataFrame(made, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(3, near * 20), (5, apart * 20), (9, None), (None, made[-1][1])])


def test_op8_keep_first(edges):
    kept = rows(op8_exact_dedup.keep_first(edges))
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 2, 4, 6, None, -8])
    assert kept[0].keys() == set(edges.columns)


# 9 token files


@pytest.mark.parametrize("file_ids", [op9_token_files.FILE_IDS, 3000])
def test_op9_round_trip(docs, edges, file_ids):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids_of = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    hot = edges.limit(0).unionByName(edges.sparkSession.range(300).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 250) as text"), allowMissingColumns=True)
    for df in (docs, edges, hot):
        found = sorted(rows(op9_token_files.token_files(df, file_ids=file_ids)), key=lambda r: r["start"])
        source = rows(df)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((r["doc_id"], len(i), zlib.crc32(i.tobytes())) for r in source for i in [ids_of(r["text"])])
        assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
        order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in found]
        assert order == sorted(order)


@pytest.mark.parametrize("values", [[5] * 1000, [0, 2**32 - 1], list(range(1024)), [7] * 900 + [2**31] * 100, [3], [0] * 1023 + [2**32 - 1]])
def test_op9_blocks(values):
    ids = np.array(values, np.uint32)
    assert (op9_token_files.unpack_block(b"xx" + op9_token_files.pack_block(ids), 2) == ids).all()


def test_op9_blocks_are_read_by_words(monkeypatch):
    """op9_token_files: up to 25 bits a value are never taken apart into bits, wherever a block ends; the ids are those that were packed."""
    rng = np.random.default_rng(3)
    blocks = [(rng.integers(0, 1 << width, n) if width else np.zeros(n)).astype(np.uint32) for width in (0, 1, 7, 8, 13, 16, 17, 25) for n in (1, 7, 1000, 1024)]
    data = [op9_token_files.pack_block(ids) for ids in blocks]
    monkeypatch.setattr(np, "unpackbits", None)
    assert all((op9_token_files.unpack_block(d + tail, 0) == ids).all() for d, ids in zip(data, blocks) for tail in (b"", b"123456789"))


def test_op9_ascii_words_pass_no_normalizer():
    """op9_token_files: lower-case ASCII words go to a tokenizer without a normalizer, others don't, and the ids are the tokenizer's own over the whole text."""
    from quillspan.llm.tokens import Encoder, tokenizer_path

    e = Encoder(tokenizer_path("word_bpe_49k.json"))
    seen = {}

    class Watched:
        def __init__(self, name, tokenizer):
            self.name, self.tokenizer = name, tokenizer

        def encode_batch_fast(self, texts, **kw):
            seen.setdefault(self.name, []).extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **kw)

    whole = e.tokenizer
    assert e.plain is not e.tokenizer and e.plain.normalizer is not whole.normalizer
    e.tokenizer, e.plain = Watched("whole", whole), Watched("plain", e.plain)
    texts = ["Plain WORDS, and don't stop. x" + str(i) + " zq" * (i % 3) for i in range(600)] + ["Stra\u00dfe \u00c9t\u00e9 e\u0301t\u00e9 \u0130x", "a\u00a0b", "", None, "\x1cA B"]
    got = list(e.encode(texts))
    assert [g.tolist() for g in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert seen["plain"] and all(t.isascii() and t == t.lower() for t in seen["plain"])


def test_op9_random_access():
    import io

    rng, sink = np.random.default_rng(0), io.BytesIO()
    w = op9_token_files.FileWriter(sink)
    docs_ = [rng.integers(0, 49408, n).astype(np.uint32) for n in (5, 0, 3000, 1, 1024, 700)]
    for i, d in enumerate(docs_):
        w.add(i if i else None, d)
    w.close()
    every, data = np.concatenate(docs_), sink.getvalue()
    assert [op9_token_files.read_at(data, i) for i in (0, 4, 1023, 1024, len(every) - 1)] == [int(every[i]) for i in (0, 4, 1023, 1024, len(every) - 1)]
    assert all((x[2] == d).all() and len(x[2]) == len(d) for x, d in zip(op9_token_files.read_file(data), docs_))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name, docs):
    enc = Encoder(tokenizer_path(name), most=100_000, batch=50_000)
    texts = [r["text"] for r in rows(docs)] + [e[1] or "" for e in EDGES] + ["a   b \n\n c\t\td   e　f  ", " lead", "trail \n", "ΑΣ ΣΑΣ. İI", "é ́x", "'s 're it's  's", "<|startoftext|> x <|endoftext|>", "1234 5,6!!! ?", "\n", "\n\n x", "a\n\nb\n\n\nc \n d\n", " a  b", "x" * 3000 + " y\n" + "zé" * 400 + ".", "a\u00a0b \u3000c", "q\0r", ". , .. a., b.,", "\nA.\nB,"]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for some in (texts, texts[::-1]):
        assert [x.astype("<u4").tobytes() for x in enc.encode(some)] == (want if some is texts else want[::-1])
    assert [x.tolist() for x in enc.encode([None, ""])] == [[], []] and list(enc.encode([])) == []


# 10 chat


def test_op10_snapshots(spark):
    turns = [("user", "hi"), ("assistant", "yo"), ("user", "x"), (None, None)]
    data = [(1, i, *t) for i, t in enumerate(turns[:2])] + [(2, i, *t) for i, t in enumerate(turns)] + [(3, i, *t) for i, t in enumerate(turns)] + [(4, 0, "user", "hi"), (4, 1, "assistant", "other")] + [(5, 0, "user", "hi")] * 2 + [(None, 0, "system", "s"), (None, None, "user", "n")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    found = {r["conv_id"]: r for r in rows(op10_chat.render_chats(df))}
    assert set(found) == {2, 4, 5, None} and found[2]["copies"] == 2 and found[2]["n_turns"] == 4
    assert found[4]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert found[None]["text"].startswith("<|im_start|>user\nn") and found[2]["text"].endswith("<|im_start|>\n<|im_end|>\n")


def test_op10_long_conversation(spark):
    df = spark.range(3000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text").unionByName(spark.range(2050).selectExpr("2L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text"))
    found = rows(op10_chat.render_chats(df))
    assert sorted((r["conv_id"], r["part"], r["n_turns"]) for r in found) == [(1, 0, 3000), (1, 1, 3000), (1, 2, 3000)]


# pipeline


CLASHES = "digest word b bits held maybe name n target taken budget score predicted copies source_size _size _key _row key gone key0 bucket2 norm rid least".split()


def test_stages_keep_clashing_columns(spark, edges):
    import corpus_pipeline as p

    docs = spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES}).withColumn("a.b", F.lit("dot"))
    plain = spark.createDataFrame(EDGES, SCHEMA)
    for name, stage in p.STAGES[:-1]:
        got, want = stage(spark, docs, SF), stage(spark, plain, SF)
        assert got.columns == docs.columns, name
        assert Counter(map(str, rows(got.select(*plain.columns)))) == Counter(map(str, rows(want))), name
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") and r["a.b"] == "dot" for r in rows(got) for c in CLASHES), name
    assert rows(p.STAGES[-1][1](spark, docs.limit(0), SF)) == []


def test_stages_on_empty_table(spark, nothing):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_op5_repeated_rows(spark):
    """One document is a third of all rows and lies in the last bucket, whatever the bucket."""
    data = [(1, "a b c", "en", "s1", 5)] * 400 + [(i, f"word {i} more", "en", "s1", 9) for i in range(2, 200)] + [(i, "x " * i, "en", "s2", 9) for i in range(200, 260)]
    df = spark.createDataFrame(data, SCHEMA)
    found = rows(op5_mixing.mix(df))
    assert len(found) == len(data)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want) <= 1 for s, want in _water(sizes).items())
    want = duckdb_rows(df, "op5_mixing")
    assert Counter((r["doc_id"], r["taken"]) for r in found) == Counter(want)


def duckdb_rows(df, name):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con.execute(f"select doc_id, taken from ({queries.oracle_sql()[name]})").fetchall()


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in p.STAGES:
        before, left = left, stage(spark, left, SF)
        if name != "packing":
            assert left.dtypes == docs.dtypes
        if name == "exact dedup":
            assert left.count() == len({re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in rows(before)})
        if name == "simhash near-dedup":
            fps = {r["doc_id"]: _plain_fingerprint(r["text"]) for r in rows(before)}
            assert {r["doc_id"] for r in rows(left)} == set(_components(fps).values())
    _check = rows(left)
    assert sum(r["length"] for r in _check) == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] * sum(1 for x in _check if x["doc_id"] == r["doc_id"] and x["doc_tokens"] == r["doc_tokens"] and x["start"] == 0) for r in _check}.values())
