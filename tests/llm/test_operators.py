"""Each operator against a plain version of itself, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from banditframe.llm import decontaminate, licenses, ogg, quality, queries, simhash, tokens, urls, wrappers
from banditframe.llm.components import components

SF = "/root/testdata/sf0.001"


# ---- 2


def greedy(word, pieces):
    n = k = 0
    while k < len(word):
        m = next((m for m in range(len(word) - k, 0, -1) if word[k : k + m] in pieces), None)
        if m is None:
            return -1
        n, k = n + 1, k + m
    return n


def test_automaton_is_greedy():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pieces = {bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(rng.integers(2, 9))}
        a = tokens.Automaton(pieces)
        for _ in range(60):
            w = bytes(rng.choice(list(b"abc"), rng.integers(0, 12)).tolist())
            assert a.count(w) == greedy(w, pieces)


def test_token_counts(spark, odd, none):
    pieces = set(tokens.read_vocabulary())
    got = {r["doc_id"]: r for r in queries.op2_token_counts(spark, SF).collect()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    known = {}
    for i, t in zip(docs.doc_id, docs.text):
        words = t.encode().split()
        for w in words:
            if w not in known:
                known[w] = greedy(b" " + w, pieces)
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(words), sum(map(known.get, words)), 0)
    rows = tokens.token_counts(odd).collect()
    assert all(r["n_words"] == r["n_tokens"] == 0 for r in rows if not (r["text"] or "").strip()) and tokens.token_counts(none).count() == 0


def test_vocabulary_and_cache_are_bounded(spark, odd):
    with pytest.raises(ValueError, match="vocabulary"):
        tokens.token_counts(odd, vocabulary=[b"x" * (1 << 20)] * 65)
    seen = tokens._Seen(tokens.Automaton([b" ", b"a", b"b"]).tables, bound=3)
    assert [seen[w] for w in (b"a", b"a" * 100, b"b", b"ab", b"ba", b"a" * 100)] == [2, 101, 2, 3, 3, 101] and len(seen) <= 3 and b"a" * 100 not in seen


# ---- 4


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, budget=2):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints(odd):
    for r in simhash.with_fingerprint(odd.withColumn("other", F.lit(1)), out="mark").collect():
        assert r["mark"] % 2**64 == plain_fingerprint(r["text"]) == simhash.fingerprint(r["text"])


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    vs = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), False)) for b in base for _ in range(40)} | {int(x) for x in rng.integers(0, 2**64, 50, dtype=np.uint64)}
    v = np.array(sorted(vs), np.uint64)
    got = sorted(tuple(sorted((int(v[i]), int(v[j])))) for x, y in simhash.trie_join(v, 2, chunk=64) for i, j in zip(x, y))
    want = sorted((a, b) for a in vs for b in vs if a < b and (a ^ b).bit_count() <= 2)
    assert got == want


@pytest.mark.parametrize("leaf", [4, 16, 4096])
def test_links_join_the_same_classes(spark, leaf):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    vs = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(12, rng.integers(0, 3), False)) for b in base for _ in range(30)} | {int(x) for x in rng.integers(0, 2**64, 30, dtype=np.uint64)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in vs], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, 2, leaf)).collect()}
    ours = [roots.get(simhash._signed(x), simhash._signed(x)) for x in vs]
    want = classes(vs)
    assert len(set(zip(ours, want))) == len(set(ours)) == len(set(want))


def test_near_duplicates(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in blank} == {3, 4, 5} and {r["component_id"] for r in blank} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 8)} == {1}
    assert simhash.near_duplicates(none).count() == 0
    r = queries.op4_simhash(spark, SF).toPandas()
    least = r.groupby("component_id").doc_id.min()
    assert (least.index == least.values).all() and len(r) == r.doc_id.nunique()


def test_components(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(100, 130).select(F.lit(100).cast("long"), "id"))
    got = {r["node"]: r["root"] for r in components(chain).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100}
    assert components(chain.filter("false")).count() == 0


# ---- 5


def test_licenses(spark, odd, none):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/c/y.txt", "word " * 9 + "\nLicensed under the Apache License, Version 2.0."), (4, "z.txt", None), (5, "a/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (6, "a/c/d/e.txt", ""), (7, None, "no licence at all is given here by anyone")]
    got = {r["doc_id"]: (r["license"], r["origin"], r["origin_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "header", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: ("GPL-3.0", "header", None), 6: ("GPL-3.0", "inherited", "a/c"), 7: (None, "none", None)}
    path = F.concat_ws("/", "source", "lang", F.lit("f.txt"))
    assert licenses.scan(odd.withColumn("path", path)).count() == odd.count()
    assert licenses.scan(none.withColumn("path", F.lit("a"))).count() == 0


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License."""


def test_licenses_over_several_lines(spark):
    comment = lambda t, mark: "\n".join(f"{mark} {x}" for x in t.split("\n"))
    code = "\n\nint main() { return 0; }\n" * 20
    texts = {"MIT": [MIT, comment(MIT, "#") + code, comment(MIT, " *") + code], "ISC": [ISC, comment(ISC, "//") + code], "Apache-2.0": [APACHE, comment(APACHE, "#") + code], "BSD-2-Clause": ["// SPDX-License-Identifier: BSD-2-Clause" + code], "EPL-2.0": ["x = 1\n# SPDX-License-Identifier: (EPL-2.0 OR MIT)"]}
    rows = [(k, f"d{k}/x.c", t, want) for k, (want, t) in enumerate((w, t) for w, ts in texts.items() for t in ts)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, want string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {k: want for k, _, _, want in rows}


def test_rows_of_one_id_and_long_lines(spark):
    long = "license " + " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "a/x", "Released under the MIT License."), (1, "a/x", "Licensed under CC BY 4.0."), (1, "a/x", "Licensed under CC BY 4.0."), (None, None, "Released under the MIT License."), (2, "b/x", long)]
    got = sorted((str(r["doc_id"]), r["license"] or "") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    # the file in the root is a licence file, so the long one inherits from it
    assert got == [("1", "CC-BY-4.0"), ("1", "CC-BY-4.0"), ("1", "MIT"), ("2", "MIT"), ("None", "MIT")]


def test_license_scores_are_cosines(spark):
    seg = spark.createDataFrame([("k", "licensed under the MIT License", 3), ("l", "a license", 1)], "of string, text string, n long")
    tem = spark.createDataFrame([("MIT", "Released under the MIT License."), ("CC", "Licensed under CC BY 4.0.")], "license string, text string")
    texts = {"licensed under the MIT License": 3, "a license": 1, "Released under the MIT License.": 1, "Licensed under CC BY 4.0.": 1}
    words = lambda t: re.findall(r"\w+(?:[.-]\w+)*", t.lower())
    df = Counter(w for t, n in texts.items() for w in set(words(t)) for _ in range(n))
    vec = lambda t: {w: c * (np.log((1 + 6) / (1 + df[w])) + 1) for w, c in Counter(words(t)).items()}
    cos = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    name = {"k": "licensed under the MIT License", "l": "a license"}
    for r in licenses.scores(seg, tem).collect():
        want = max((cos(vec(name[r["of"]]), vec(t)), k) for k, t in (("MIT", "Released under the MIT License."), ("CC", "Licensed under CC BY 4.0.")))
        assert (r["score"], r["license"]) == (pytest.approx(want[0], abs=1e-6), want[1])


# ---- 6


def plain_text(html):
    from html import unescape

    body = re.search(r"(?s)<article>(.*?)</article>", html)[1]
    return " ".join(" ".join(unescape(x) for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", body))).split())


def test_main_text(spark):
    r = queries.op6_wrappers(spark, SF).toPandas()
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    assert len(r) == len(pages) and all(t == plain_text(pages[i]) and n == len(t) for i, t, n in zip(r.page_id, r.text, r.n_chars))


def test_main_text_of_other_layouts(spark):
    pages = [
        (1, "http://a.b/1", "<html><body><header>Top</header><nav>Menu</nav><main><h1>T &amp; U</h1><p>One <b>two</b><p>three<br>four</main><aside class='x'>Side</aside><div class='comments'><p>c</p></div><footer>F</footer>"),
        (2, "http://a.b/2", "<body><main><h1>V</h1><p>five</p><div class='cookie-notice'>Accept</div><form>Name<input></form></main>"),
        (3, "http://c.d/1", "<div id=content><p>only\n text</p><script>var a='<p>no</p>'</script><!-- no --></div><div class='sidebar'>no</div>"),
        (4, "http://c.d/2", None), (5, None, ""), (6, "bad", "plain &lt;words&gt;"), (7, "http://a.b/1", "<p>broken <"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("paths", F.lit(1))
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}
    assert got == {1: "T & U One two three four", 2: "V five", 3: "only text", 4: "", 5: "", 6: "plain <words>", 7: "broken <"}
    assert wrappers.main_text(df.filter("false")).count() == 0


# ---- 7


def test_leaks(spark, odd, none):
    bench = spark.createDataFrame([(1, "A train from Paris travels 120 km in 3 hours with Anna on board at what speed"), (2, "what colour is the early morning sky over the quiet sea"), (3, "too short"), (4, None), (5, "zeta eta theta iota")], "item_id long, text string")
    rows = [
        (1, "Q: a train from Rome travels 450 km in 5 hours with Otto on board at what speed? Yes"), (2, "and WHAT colour is the early morning sky, over the quiet sea."), (3, "nothing to see in this long text about other things"), (4, None), (5, ""),
        (6, "what colour is the pale evening sun over a quiet sea"), (7, "see zeta eta theta iota here"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (7, 5)}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.filter("false")).count() == 0
    assert decontaminate.decontaminate(odd, bench.filter("item_id < 5")).count() == odd.count()


def test_inconsistent_slots_are_no_leak(spark):
    item = "from 1 to 2 and from 3 to 4 and from 5 to 6 go the steps"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "from 7 to 8 and from 9 to 10 and from 11 to 12 go the steps"), (2, "from 7 to 7 and from 7 to 7 and from 7 to 7 go the steps")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_leaks_of_the_tables(spark):
    docs, bench = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    want = {(i, j) for i, t in zip(docs.doc_id, docs.text) for j, b in zip(bench.item_id, bench.text) if b in t}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()} >= want


# ---- 8


def test_ogg(spark, odd, none):
    assert ogg.page_checksum(b"\x01") == 0x04C11DB7
    for n in (0, 1, 63, 64, 65, 4096, 255 * 255, 300_000):
        data = bytes(range(256)) * (n // 256 + 1)
        pay = ogg.payload("x" * n)
        assert len(pay) % 64 == 0 and len(pay) >= max(64, n) and pay[:n] == b"x" * n
        streams = ogg.parse(ogg.encode(data))
        sound = streams[ogg.SAMPLES][1:]
        assert b"".join(p for p, _, _ in sound) == data and sound[-1][1:] == (len(data), len(data) / ogg.RATE)
        assert [end for _, end, _ in sound] == [min(k + ogg.PACKET, len(data)) for k in range(0, len(data), ogg.PACKET)]
        assert [t for _, _, t in sound] == [end / ogg.RATE for _, end, _ in sound]
    rows = ogg.features(ogg.media(odd)).collect()
    for r in rows:
        pay = ogg.payload(r["text"])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r["media_sha256"] == hashlib.sha256(ogg.encode(pay)).hexdigest()
        assert r["error"] is None and r["feature"]
    assert ogg.features(ogg.media(none)).count() == 0


def test_damaged_media_are_rows(spark):
    good = ogg.encode(ogg.payload("abc" * 100))
    flipped = bytearray(good)
    flipped[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ogg.parse(bytes(flipped))
    second = ogg._pages([(b"Text    ", 0), (b"samples=1", 1)], ogg.TEXT)
    files = {"good": good, "flipped": bytes(flipped), "short": good[:-3], "head": good[:20], "none": None, "empty": b"", "noise": b"x" * 200, "twice": good + good, "text": b"".join(second), "skip": b"".join(p for k, p in enumerate(second) if k)}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "name string, media binary")
    got = {r["name"]: r for r in ogg.features(df).collect()}
    assert {k for k, r in got.items() if r["error"] is None} == {"good", "none"} and {k for k, r in got.items() if r["payload_bytes"] is not None} == {"good"}


def test_granules_of_a_page_that_is_cut_short():
    head = b"PCM     " + bytes(8) + (8000).to_bytes(4, "big") + bytes([0, 1])
    pages = ogg._pages([(head, 0), (b"a" * 100, 100), (b"b" * 100, 200), (b"c" * 100, 250)], 9)
    assert [g for _, g, _ in ogg.parse(b"".join(pages))[9]] == [0, 100, 200, 250]


# ---- 9


def test_url_lists(spark):
    ts = lambda s: f"2024-{s} 00:00:00"
    entries = [("bad.com", "spam", "add", ts("01-10")), ("bad.com", "spam", "remove", ts("03-10")), ("bad.com", "adult", "add", ts("05-10")), ("bad.com/x", "ads", "add", ts("02-01")), ("bad.com", "spam", "add", None), (None, "x", "add", ts("01-01")), ("tie.com", "x", "add", ts("01-01")), ("tie.com", "x", "remove", ts("01-01"))]
    caps = [(1, "http://bad.com/a", ts("01-09")), (2, "http://WWW.bad.com/a", ts("01-10")), (3, "http://bad.com/x/y?q", ts("02-05")), (4, "http://bad.com/a", ts("04-01")), (5, "http://bad.com", ts("12-01")), (6, None, ts("01-10")), (7, "http://bad.com/a", None), (8, "http://notbad.com/", ts("01-15")), (9, "http://tie.com", ts("02-02")), (2, "http://WWW.bad.com/a", ts("01-10"))]
    e = spark.createDataFrame(entries, "pattern string, category string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    c = spark.createDataFrame(caps, "page_id long, url string, fetched string").withColumns({"fetched": F.col("fetched").cast("timestamp"), "pattern": F.lit("mine")})
    rows = urls.listed(c, e).collect()
    assert len(rows) == len(caps)
    assert {r["page_id"]: r["category"] for r in rows} == {1: None, 2: "spam", 3: "ads", 4: None, 5: "adult", 6: None, 7: None, 8: None, 9: None}
    assert urls.listed(c.filter("false"), e).count() == 0 and not any(r["listed"] for r in urls.listed(c, e.filter("false")).collect())


def plain_listed(captures, entries):
    """captures (id, url, time) -> the pattern that decides, by looking at every entry for every capture."""
    by = {}
    for pattern, category, action, at in entries:
        if None not in (pattern, action, at):
            key = (pattern.lower(), at)
            by[key] = max(by.get(key, ("", "")), (action, category))
    out = []
    for _, url, at in captures:
        m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)[^/?#]*/?([^?#]*)", (url or "").lower())
        host, segs = (m[1], [s for s in m[2].split("/") if s]) if m else ("", [])
        best = None
        for p in {p for p, _ in by}:
            h, *head = p.split("/")
            covers = host and (host == h or host.endswith("." + h) and "." in h) and segs[: len(head)] == head
            times = sorted(t for q, t in by if q == p and at is not None and t <= at)
            if covers and times and by[p, times[-1]][0] == "add":
                best = max(best or (0, ""), (len(p), p))
        out.append(best[1] if best else None)
    return out


def test_url_lists_against_all_entries(spark):
    rng = np.random.default_rng(11)
    hosts = ["a.com", "b.a.com", "x.org", "c.b.a.com", "A.com"]
    time = lambda: f"{rng.integers(2019, 2024)}-{rng.integers(1, 13):02d}-{rng.integers(1, 28):02d} 00:00:00"
    entries = [(str(rng.choice(hosts)) + str(rng.choice(["", "", "/p", "/p/q", "/P"])), str(rng.choice(["k", "l"])), str(rng.choice(["add", "remove"])), time()) for _ in range(160)]
    entries += [("Bad.com", "k", "add", "2020-01-01 00:00:00"), ("bad.com", "l", "remove", "2020-01-01 00:00:00"), ("bad.com", "k", "add", "2021-01-01 00:00:00")]
    long = "/".join(["seg"] * 30_000)
    caps = [(k, f"http://{rng.choice([*hosts, 'z.net', 'bad.com', 'c.d.bad.com'])}/{rng.choice(['', 'p', 'p/q/r', 'P/q', 'n'])}", time()) for k in range(300)]
    caps += [(900, f"http://a.com/p/{long}", "2022-05-05 00:00:00"), (901, "http://bad.com/", "9999-01-01 00:00:00"), (902, "http://bad.com/", "2020-06-01 00:00:00"), *caps[:3]]
    e = spark.createDataFrame(entries, "pattern string, category string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    c = spark.createDataFrame(caps, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    got = urls.listed(c, e).select("page_id", "pattern").collect()
    want = plain_listed(caps, entries)
    assert sorted((r["page_id"], r["pattern"] or "") for r in got) == sorted((x[0], p or "") for x, p in zip(caps, want)) and sum(map(bool, want)) > 50


# ---- 10


def test_quality_of_documents_without_labels(spark):
    """Held out: the model sees four of five labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    r = quality.judge(docs, labels.filter("doc_id % 5 > 0"), keep_text=False)
    both = r.join(labels.filter("doc_id % 5 = 0"), "doc_id").toPandas()
    assert len(both) > 500 and (both.keep.astype(int) == both.quality).mean() > 0.985


def test_quality(spark, odd, none):
    r = queries.op10_quality(spark, "/root/testdata/sf0.01").toPandas()
    assert len(r) == 1000
    lab = spark.createDataFrame([(1, 1), (2, 1), (8, 0), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    rows = quality.judge(odd, lab).collect()
    assert len(rows) == odd.count() and not any(r["keep"] for r in rows if not (r["text"] or "").strip())
    assert quality.judge(none, lab).count() == 0 and quality.judge(odd, lab.filter("false")).filter("keep").count() == 8


def test_posteriors_leave_the_document_out(spark):
    r = queries.op10_quality(spark, SF).toPandas()
    logit = lambda p: np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    p, m = r.evidence, r.evidence.mean()
    strength = lambda spread: min(max(m * (1 - m) / spread - 1 if spread else 1e4, 1.0), 1e4)
    h = r.groupby("source").evidence.agg(["size", "sum"])
    k0 = strength((np.maximum(h["size"] * (h["sum"] / h["size"] - m) ** 2 - m * (1 - m), 0)).sum() / len(r))
    post = (k0 * m + h["sum"]) / (k0 + h["size"])
    d = r.groupby(["source", "lang"]).evidence.agg(["size", "sum"])
    b = post.reindex(d.index.get_level_values(0)).to_numpy()
    k1 = strength((np.maximum(d["size"] * (d["sum"] / d["size"] - b) ** 2 - b * (1 - b), 0)).sum() / len(r))
    assert r.host_posterior.to_numpy() == pytest.approx(post.reindex(r.source).to_numpy())
    for i in range(0, len(r), 7):
        rest = r.drop(index=i)
        mean = rest.evidence.mean()
        host = rest[rest.source == r.source[i]].evidence
        path = rest[(rest.source == r.source[i]) & (rest.lang == r.lang[i])].evidence
        above = (k0 * mean + host.sum()) / (k0 + len(host))
        others = (k1 * above + path.sum()) / (k1 + len(path))
        z = logit(p[i]) + logit(others) - logit(mean)
        assert r.posterior[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6, abs=1e-9)


def test_evidence_is_the_models(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, "doc_id")
    for r in quality.with_evidence(docs, model).limit(40).collect():
        x = quality.vector(r["text"]).toArray()
        assert r["__f"]["evidence"] == pytest.approx(1 / (1 + np.exp(-(model.intercept + x @ model.weights))), rel=1e-6, abs=1e-9)


def test_sparse_sites_shrink(spark):
    rows = spark.createDataFrame([("big", "p", 0.9)] * 400 + [("bad", "p", 0.1)] * 400 + [("one", "p", 0.1)], "h string, d string, p double")
    got = {r["__h"]: r for r in quality.sites(rows, "h", "d").collect()}
    assert abs(got["big"]["host_posterior"] - 0.9) < 0.02 and got["bad"]["host_posterior"] < 0.12
    assert got["one"]["host_posterior"] > got["bad"]["host_posterior"] + 0.05
