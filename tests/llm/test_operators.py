import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import CLASH, LONG, ROWS, frame, key, prose
from weftline.llm import fingerprint, licenses, mixing, near, packing, quality, rans, substring, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(text):
    return tokens.encoder(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- 1: substring dedup ----
def removed_by_force(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_substring_edges(spark):
    got = [tuple(r) for r in substring.digests(frame(spark)).collect()]
    want = [(r[0], *x) for r, x in zip(ROWS, removed_by_force([r[1] for r in ROWS]))]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring.digests(frame(spark, [])).collect() == []


def test_substring_shared_passages(spark):
    shared = prose(50, 60)
    rows = [(k, prose(100 + k, 30 + k) + " " + shared + " " + prose(200 + k, 20), "en", "a", 1) for k in range(12)]
    rows += [(20 + k, " ".join((prose(300, 80)).split()[k : k + 36]), "en", "a", 1) for k in range(10)]
    rows += [(40, ("same " * 50).strip(), "en", "a", 1), (41, prose(60, 34), "en", "a", 1), (42, prose(60, 34), "en", "a", 1), (43, prose(61, 35), "en", "a", 1), (44, prose(61, 35), "en", "a", 1)]
    got = sorted(tuple(r) for r in substring.digests(frame(spark, rows)).collect())
    assert got == sorted((r[0], *x) for r, x in zip(rows, removed_by_force([r[1] for r in rows])))


def test_substring_keep(spark):
    shared = prose(50, 60)
    rows = [(1, "first words here. " + shared + "\nlast line", "en", "a", 1), (2, shared, "en", "a", 1), (3, "untouched  text\n", "en", "a", 1), (4, None, "en", "a", None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.keep(frame(spark, rows)).collect()}
    assert got[1] == ("first words here.\nlast line", 27) and got[3][0] == "untouched  text\n" and got[4] == (None, None) and 2 not in got
    assert substring.keep(frame(spark, rows)).columns == frame(spark, rows).columns


def test_word_hashes_chunks_agree():
    data = (LONG + " ünï\tcode\n").encode() * 3
    assert (substring.word_hashes(data, chunk=1000) == substring.word_hashes(data)).all()
    assert len(substring.word_hashes(data)) == len(data.split())
    assert len(substring.word_hashes(b"x" * 5000, chunk=100)) == 1


# ---- 2: packing ----
def test_packing_edges(spark):
    rows = packing.best_fit(frame(spark)).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.sequence_id].append((r.offset, r.length))
    for places in by_doc.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {6: ids_of(LONG), 8: ids_of("wörd " * 400)}
    for d, want in ids.items():
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        assert mine[0][2] == (len(want) % 2048 or 2048) and all(x[2] == 2048 for x in mine[1:])
        assert all(c == crc(want[s : s + n]) for _, s, n, c in mine)
        assert sum(x[2] for x in mine) == len(want)
    total = sum(r.length for r in rows)
    assert total == sum(len(ids_of(r[1])) for r in ROWS)
    assert packing.best_fit(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    counts = dict(collections.Counter(rng.integers(1, 65, 800).tolist()))
    recipes = packing.plan(counts, 64)
    used = collections.Counter()
    for lengths, times in recipes:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == counts
    gaps = []
    for x in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):  # best-fit decreasing
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 64) - x)
    assert sum(t for _, t in recipes) <= len(gaps) + 1


# ---- 3: WARC ----
def test_warc_edges(spark):
    big = "<p>" + prose(5, 300) + "</p>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, "http://a/3", big), (4, "http://a/\r\nX: y", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (8, "u", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})
    got = warc.round_trip(pages).collect()
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        top = 3 if html == big else i
        revisit = len(body) >= 1000 and i != top
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_lookup(spark, tmp_path):
    """Every record is found by its id, through its frame and offset, and a revisit names the record that has its payload."""
    html = {k: prose(k // 2, 300 + k // 2) for k in range(40)}
    pages = spark.createDataFrame([(k, f"http://h/{k}", v) for k, v in html.items()], "page_id long, url string, html string")
    index = {r.record_id: r.asDict() for r in warc.write(warc.plan_revisits(pages, "page_id", "url", "html", 1000), str(tmp_path), frame_bytes=5000).collect()}
    assert len(index) == 40 and len({r["frame"] for r in index.values()}) > 3
    for k, row in index.items():
        headers, block = warc.lookup(row, str(tmp_path))
        assert headers["WARC-Record-ID"] == f"<urn:page:{k}>"
        if row["record_type"] == "revisit":
            named = int(headers["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
            there, block = warc.lookup(index[named], str(tmp_path))
            assert there["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"]
        assert block.partition(b"\r\n\r\n")[2].decode() == html[k]


def test_packing_in_small_buckets(spark):
    """Ranks over many buckets give each place once."""
    cut = spark.range(900).selectExpr("id as doc_id", "0 as piece", "0L as start", "id % 5 * 300 + 100 as length", "id as ids_crc32")
    rows = packing.pack(cut, 2048, rows_per_bucket=7).collect()
    assert len(rows) == 900
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_warc_seek_and_checksum(tmp_path):
    from pyarrow import fs

    files, path = fs.LocalFileSystem(), str(tmp_path / "a.warc.zst")
    archive = warc._Archive(files, path, 3)
    plain = [warc.record(k, "u", bytes([k]) * 500, hashlib.sha1(bytes([k]) * 500).hexdigest(), None, "2024-01-01T00:00:00Z") for k in range(5)]
    for p in plain:
        archive.add(p)
    archive.close()
    with files.open_input_file(path) as s:
        table = warc.seek_table(s)
        assert warc.read_frame(s, table[3]) == plain[3]
        assert next(warc.parse(plain[2]))[1].endswith(bytes([2]) * 500)
        with pytest.raises(ValueError):
            warc.read_frame(s, (*table[1][:3], table[1][3] ^ 1))


# ---- 4: quality ----
def base_by_force(text):
    t = text or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality_edges(spark):
    got = quality.line_first(frame(spark)).collect()
    assert sorted([(r.doc_id, *r[1:7]) for r in got], key=key) == sorted([(r[0], *base_by_force(r[1])) for r in ROWS], key=key)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.line_first(frame(spark, [])).collect() == []


@pytest.mark.parametrize("line", ["home | about | contact | login", "All rights reserved.", "BUY!! NOW!! THE!! BEST!! OFFER!!", "foo%%% bar*** baz### qux$$$ a&&& b", "go " * 20])
def test_quality_junk_lines(line):
    assert quality.line_fault(line.strip(), False)
    text = "\n".join([line.strip() + f" x{k}" for k in range(20)])
    assert not quality.judge(text + "\n" + prose(3, 5))[6]


@pytest.mark.parametrize("word", ["cookies", "copyright", "javascript", "a newsletter", "all rights reserved"])
def test_quality_keeps_paragraphs_that_name_a_notice(word):
    text = f"{prose(1, 30)} The word {word} stands in it. {prose(2, 30)}"
    assert quality.judge(text)[6] and quality.judge(text)[-1] == text
    assert quality.line_fault(word.capitalize() + " here.", False) == "boilerplate"


def test_quality_keeps_prose(spark):
    text = "\n".join(prose(k, 30) for k in range(8))
    assert quality.judge(text)[6] and quality.judge(text)[-1] == text
    noisy = text + "\nReleased under the MIT License.\n" + text.split("\n")[0]
    assert quality.judge(noisy)[6] and quality.judge(noisy)[-1] == text
    kept = quality.keep(frame(spark, [(1, noisy, "en", "a", 1), (2, "short", "en", "a", 5), (3, None, None, None, None)])).collect()
    assert [(r.doc_id, r.text, r.n_chars, r.size) for r in kept] == [(1, text, len(text), "x-size")]


# ---- 5: rANS ----
def test_rans_edges(spark):
    got = rans.round_trip(frame(spark)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for r in order:
        ids = ids_of(r[1])
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert rans.round_trip(frame(spark, [])).collect() == []


@pytest.mark.parametrize("ids", [[0], [5] * 3000, list(range(5000)), [1, 2] * 77 + [50_000]])
def test_rans_block(ids):
    ids = np.array(ids, np.uint16)
    freq = rans.frequencies(ids)
    assert freq.sum() == 1 << rans.SCALE and (freq[np.unique(ids)] > 0).all()
    table = rans.Table(freq)
    data = rans.encode_block(ids, table, 64)
    assert (rans.decode_block(data, len(ids), table, table.lookup(), 64) == ids).all()


def test_tokens_equal_the_library():
    coder = tokens.Encoder(tokens.default_path(), cache=50)
    texts = ["", "a", " a", "a ", "a  b\n\n c", "x  y", "it's <|endoftext|> ok", "tab\tb \n", "w,w, w,. w", LONG[:3000], "日本 語\r\nz", "\n", " \n", "a\n b"]
    for t in [*texts, *texts]:
        assert coder.encode(t).tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


# ---- 6: licenses ----
def test_license_edges(spark):
    bsd = licenses.TEMPLATES["bsd-grant"]
    rows = [*ROWS, (20, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 500), "en", "a", 1), (21, prose(5, 9) + " " + bsd.replace("binary forms, ", "") + " " + prose(6, 40), "en", "a", 1), (22, "the license of the version is free software under the sun", "en", "a", 1)]
    got = {r.doc_id: r for r in licenses.licenses(frame(spark, rows)).collect() if r.license or r.doc_id in (20, 21, 22)}
    assert set(got) == {20, 21, 22} and got[20].license == "mit-notice" and got[20].first_word == 50
    assert got[21].license == "bsd-grant" and got[21].coverage > 0.95 and got[22].license is None
    assert licenses.licenses(frame(spark, rows)).count() == len(rows) and licenses.licenses(frame(spark, [])).collect() == []


def test_patience():
    pairs = licenses.align("a b c d e f".split(), "x a c d y f".split())
    assert pairs == [(0, 1), (2, 2), (3, 3), (5, 5)]
    assert licenses.align("the cat the dog".split(), "the the dog".split())[-1] == (3, 2)


def test_license_whole_grant(spark):
    """The MIT grant is its whole text: a body without its first line is one, the first line alone or before another licence isn't."""
    mit = licenses.TEMPLATES["mit-grant"]
    body = mit.split("obtaining a copy ", 1)[1]
    ofl = "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software"
    rows = [(20, prose(5, 9) + " " + mit.replace("merge, ", "") + " " + prose(6, 40), "en", "a", 1), (21, prose(7, 9) + " " + body, "en", "a", 1), (22, prose(8, 30) + " " + ofl + " " + prose(9, 30), "en", "a", 1), (23, mit[:76], "en", "a", 1)]
    got = {r.doc_id: r for r in licenses.licenses(frame(spark, rows)).collect()}
    assert got[20].license == got[21].license == "mit-grant" and got[20].coverage > 0.95 and 0.8 <= got[21].coverage < 0.9
    assert got[22].license is None and got[23].license is None


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_of_each_template(name):
    """Each text alone is told from all others, also with words dropped where it is long, and so are three in a row."""
    scanner, words = licenses.Scanner(licenses.TEMPLATES, 0.8, 2.0), licenses.TEMPLATES[name].split()
    text = " ".join(words)
    assert scanner.scan(f"{prose(1, 20)} {text} {prose(2, 20)}")[0] == name
    assert scanner.scan(f"{prose(1, 20)} {text} {text} {text} {prose(2, 20)}")[0] == name
    if len(words) > 60:
        assert scanner.scan(f"{prose(3, 20)} {' '.join(w for k, w in enumerate(words) if k % 13 != 12)} {prose(4, 20)}")[0] == name
    assert scanner.scan(" ".join(words[: len(words) // 4]))[0] != name


def test_two_licenses_in_one_text():
    mit, gpl = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["gpl-3.0-header"]
    got = licenses.Scanner(licenses.TEMPLATES, 0.8, 2.0).scan(f"{mit} {prose(1, 300)} {gpl}")
    assert got[0] == "mit-text" and got[5] == ["gpl-3.0-header", "mit-text"]


# ---- 7: mixing ----
def targets_by_force(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, out, active = sum(sizes.values()), {}, set(order)
    while active:
        whole = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / whole > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / whole for s in active}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        active -= set(over)
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mixing_edges(spark):
    rows = ROWS + [(100 + k, prose(k, 40), "en", "e" if k % 2 else None, 1) for k in range(60)]
    got = mixing.takes(frame(spark, rows)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets_by_force(sizes)
    assert len(got) == len(rows)
    for source, goal in want.items():
        mine = [r for r in got if r.key == ("n" if source is None else "s" + source)]
        assert all(r.source_size == sizes[source] and abs(r.target - goal) < 1e-6 * max(1, goal) for r in mine)
        assert abs(sum(r.taken for r in mine) - goal) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.takes(frame(spark, rows)).collect()), key=key)
    assert mixing.takes(frame(spark, [])).collect() == []


def test_mix_follows_the_schedule(spark):
    rows = [(k, prose(k, 30 + k), "en", "abc"[min(2, k % 7)], 1) for k in range(80)]
    docs = frame(spark, rows)
    made, placed = mixing.blocks(docs, block=64)
    made, docs_of, by_key = made.collect(), {r.row: r for r in placed.collect()}, collections.defaultdict(list)
    taken = collections.Counter()
    for r in made:
        taken[docs_of[r.row].doc_id] += r.upto - r.first
        d = docs_of[r.row]
        by_key[d.key].append((r.slot, r.lap * d.source_size + d.pos + r.first, r.upto - r.first))
    for key_, parts in by_key.items():  # slots in order give the source's stream without a gap, in blocks of 64 words
        parts.sort()
        at = 0
        for _, start, n in parts:
            assert start == at
            at += n
        filled = collections.Counter()
        for slot, _, n in parts:
            filled[slot] += n
        assert sorted(filled.values())[1:] == [64] * (len(filled) - 1)
    total = sum(sum(n for *_, n in p) for p in by_key.values())
    for key_, parts in by_key.items():  # any stretch of the schedule is near the mix
        share = sum(n for *_, n in parts) / total
        for upto in range(10, total // 64):
            assert abs(len({s for s, *_ in parts if s < upto}) - share * upto) < 4
    out = mixing.mix(docs, block=64)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == taken == collections.Counter({r.doc_id: r.taken for r in mixing.takes(docs, block=64).collect() if r.taken})
    order = [r.doc_id for r in out.coalesce(1).collect()]
    copies = {}
    for r in made:
        copies[r.row, r.lap] = min(copies.get((r.row, r.lap), 1 << 60), r.slot)
    assert order == [docs_of[row].doc_id for _, _, _, row in sorted((slot, lap, docs_of[row].pos, row) for (row, lap), slot in copies.items())]


def test_mix_edges(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    got = mixing.mix(frame(spark)).collect()
    assert got and all(r.size == "x-size" for r in got)
    long = sum(len(WORD.findall(r.text)) for r in got if r.doc_id == 6)
    assert 0 < long <= 3 * len(WORD.findall(LONG))


# ---- 8: fingerprints ----
def test_fingerprint_edges(spark):
    got = fingerprint.with_edits(frame(spark)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, r in enumerate(order):
        t, n = r[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = next(r for r in got if r.doc_id == 6)
    assert long.near_edited > 0.5 > long.near_next
    assert fingerprint.with_edits(frame(spark, [])).collect() == []


def lanes_by_force(text):
    """Both vectors from their definition."""
    import xxhash

    exact, near_ = [0] * 16, [0] * 64
    for p in (" ".join(WORD.findall(x)) for x in text.split("\n")):
        if not p:
            continue
        d = hashlib.sha512(p.encode()).hexdigest()
        exact = [(x + int(d[8 * k : 8 * k + 8], 16)) % (1 << 32) for k, x in enumerate(exact)]
        w = p.split(" ")
        for i in range(len(w)):
            h = 42
            for part in w[i : i + 3]:  # a missing word leaves the hash as it is
                h = xxhash.xxh64_intdigest(part.encode(), seed=h)
            h -= (h >> 63) << 64
            near_[h & 63] += ((h >> 20) & 2) - 1
    return exact, near_


def test_fingerprints_by_force(spark):
    got = fingerprint.with_edits(frame(spark)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []

    def text_of(v):
        return "".join(f"{x % (1 << 32):08x}" for x in v[0] + v[1])

    def likeness(a, b):
        dot = lambda x, y: float(sum(p * q for p, q in zip(x, y)))
        scale = (dot(a[1], a[1]) * dot(b[1], b[1])) ** 0.5
        return 1.0 if a == b else 0.0 if not scale else min(1.0, max(0.0, dot(a[1], b[1]) / scale))

    for k, r in enumerate(order):
        t, n = r[1] or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        a, b, c = (lanes_by_force(x) for x in (t, t[: len(t) - q] + n[:q], n))
        want.append((r[0], text_of(a), text_of(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    assert sorted([(r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=key) == sorted(want, key=key)


def test_fingerprint_lanes_do_not_wrap(spark):
    rows = [(0, "same " * 40_000, "", "", 0), (1, prose(1, 9000), "", "", 0)]
    got = {r.doc_id: r for r in fingerprint.with_edits(frame(spark, rows)).collect()}
    assert got[0].near_edited > 0.9


def test_fingerprint_is_a_multiset_hash(spark):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    rows = [(0, f"{a}\n{b}\n{c}", "", "", 0), (1, f"{c}\n{a}\n\n{b}", "", "", 0), (2, f"{a}\n{b}", "", "", 0), (3, c, "", "", 0), (4, f"{a}\n{b}\n{b}\n{c}", "", "", 0)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    assert got[0].fingerprint == got[1].fingerprint != got[4].fingerprint
    whole = [(x + y) % (1 << 32) for x, y in zip(got[2].exact, got[3].exact)]
    assert whole == list(got[0].exact)
    with_ops = spark.createDataFrame([(list(got[0].exact), list(got[3].exact))], "a array<long>, b array<long>").select(fingerprint.combine(F.col("a"), F.col("b"), 32, -1).alias("x")).first().x
    assert with_ops == list(got[2].exact)


# ---- 9: near duplicates ----
def test_near_edges(spark):
    got = near.near_classes(frame(spark)).collect()
    classes = {(r.doc_id, r.node): r.class_id for r in got}
    assert len(got) == len(ROWS)
    by_id = collections.defaultdict(set)
    for (d, _), c in classes.items():
        by_id[d].add(c)
    assert by_id[0] == by_id[1] == by_id[10] == {0} and by_id[2] == {2} and by_id[6] == {6}
    assert near.near_classes(frame(spark, [])).collect() == []


def test_near_groups_and_chains(spark):
    base = prose(7, 200).split()
    rows = []
    for k in range(40):  # copies of one centre, each with other words changed
        w = list(base)
        for j in range(3):
            w[(k * 5 + j * 61) % 200] = f"new{k}x{j}"
        rows.append((k, " ".join(w), "en", "a", 1))
    rows.append((40, " ".join(base), "en", "a", 1))
    rows += [(100 + k, prose(1000 + k, 100), "en", "a", 1) for k in range(30)]
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, rows)).collect()}
    assert {got[k] for k in range(41)} == {0} and all(got[100 + k] == 100 + k for k in range(30))
    kept = near.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 130)]


def test_near_keeps_unlike_rows_of_equal_ids(spark):
    rows = [*ROWS, *[(None, prose(200 + k, 40), "en", "a", 1) for k in range(3)], (None, prose(200, 40), "en", "a", 1)]
    kept = [(r.doc_id, r.text or "") for r in near.one_of_each(frame(spark, rows)).collect()]
    assert len(kept) == len(set(kept)) and {t for d, t in kept if d == 7} == {"one two", prose(3, 50)}
    assert {t for d, t in kept if d is None} == {prose(4, 40), *(prose(200 + k, 40) for k in range(3))}


def test_near_families_by_force(spark):
    """Texts that share a long passage, so that buckets hold many classes: every link of two texts in one bucket counts."""
    import random

    rows, sets = [], []
    for k in range(80):
        own = [f"own{k}x{j}" for j in range(6)]
        for copy in range(2):
            r = random.Random(2 * k + copy)
            words = prose(70, 160).split()
            for j in range(2):
                words[r.randrange(160)] = f"new{k}x{copy}x{j}"
            rows.append((2 * k + copy, " ".join(words + own), "en", "a", 1))
            sets.append(near.shingles(rows[-1][1].encode()))
    keys = near.band_keys(near.signatures(sets, near.BANDS * near.ROWS), near.BANDS, near.ROWS)
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (keys[a] == keys[b]).any() and near.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert len(set(want)) > 20 and len(want) - len(set(want)) > 20
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, rows)).collect()}
    assert got == dict(enumerate(want))


def test_near_templates_by_force(spark):
    """Pages of one template: those with the same two fields are links, all others lie just below."""
    import random

    base, rows, sets = [f"w{k}" for k in range(400)], [], []
    for k in range(60):
        w, r = list(base), random.Random(k)
        for j in range(18):
            w[40 + j], w[240 + j] = f"f{k // 2}x{j}", f"g{k // 2}x{j}"
        for _ in range(4):
            w[r.randrange(400)] = f"own{k}"
        rows.append((k, " ".join(w), "en", "a", 1))
        sets.append(near.shingles(rows[-1][1].encode()))
    want = {(a, b) for a in range(60) for b in range(a) if near.similarity(sets[a], sets[b]) >= 0.8}
    assert len(want) == 30 and all(a - b == 1 for a, b in want)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_classes(frame(spark, rows)).collect()}
    assert got == {k: (k // 2 * 2, 1) for k in range(60)}


def test_alike_in_blocks(spark):
    """Blocks of any size give each pair of a bucket's members of different roots once, in the first band they share."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 62, (40, 3))
    keys[:, 1] = 7
    keys[5, 0] = keys[9, 0]
    roots = [k // 4 for k in range(40)]
    rows = [(1, 7, bytes([k]), keys[k].tolist(), bytes([roots[k]]), 40) for k in range(40)] + [(0, int(keys[5, 0]), bytes([k]), keys[k].tolist(), bytes([roots[k]]), 2) for k in (5, 9)]
    members = spark.createDataFrame(rows, "band int, key long, node binary, keys array<long>, root binary, n long")
    want = sorted((bytes([a]), bytes([b])) for a in range(40) for b in range(a) if roots[a] != roots[b])
    for block in (3, 11, 512):
        assert sorted((bytes(r.a), bytes(r.b)) for r in near.alike(members, 4, 0.1, block).collect()) == want


def test_signature_estimates():
    a, b = prose(1, 400).split(), prose(1, 400).split()
    for k in range(0, 400, 40):
        b[k] = f"zz{k}"
    x, y = near.shingles(" ".join(a).encode()), near.shingles(" ".join(b).encode())
    s = near.signatures([x, y], 2048)
    assert abs((s[0] == s[1]).mean() - near.similarity(x, y)) < 0.05


def test_components(spark):
    pairs = [(bytes([k]), bytes([k + 1])) for k in range(20)] + [(bytes([100]), bytes([101]))]
    got = {bytes(r.node): bytes(r.root) for r in near.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert got == {**{bytes([k]): bytes([0]) for k in range(21)}, bytes([100]): bytes([100]), bytes([101]): bytes([100])}


# ---- 10: toxicity ----
def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(frame(spark), toxicity.learn(frame(spark), labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.scores(frame(spark, []), toxicity.learn(frame(spark, []), labels.limit(0))).collect() == []


def test_toxicity_held_out(spark):
    rows, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = prose(k, 60).split()
        for j in range(3 if bad else 0):
            w.insert(7 * j + 3, ["dolt", "oafish", "nitwit"][(k + j) % 3])
        rows.append((k, " ".join(w), "en", "a", 1))
        marks.append((k, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = [r for r in toxicity.scores(docs, toxicity.learn(docs, labels)).collect() if r.held_out]
    assert len(got) > 60 and sum(r.predicted == (r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)


def test_grammar_rewrites():
    begin, machine = toxicity.grammar()

    def read(symbols):
        state, out = begin, ""
        for a in symbols:
            state, b, _ = machine[state][a]
            out += b
        return out

    assert read("OLO") == "OIO" and read("TOL") == "OOJ" and read("NOL")[-1] == "i" and read("ROL")[-1] == "q" and read("NOOOOOL")[-1] == "I"
    assert read("MV")[-1] == "H" and read("TMV")[-1] == "K" and read("LOT")[-1] == "D" and read("NRL")[-1] == "q"
    assert read("V") == "O" and read("MOOOOOV")[-1] == "O"  # a word of harm alone is no threat


def clause(text, insults=("dolt",)):
    return toxicity.match([("L", 5.0) if w in insults else (toxicity.CLASS.get(w, "O"), 4.0) for w in text.lower().split()])


def test_grammar_scores_clauses():
    assert clause("you are a dolt") == ("J", 6.0) == clause("what a dolt you are")
    assert clause("what a dolt") == ("I", 5.0) and clause("he is not a dolt")[0] == "i" and clause("she said he was a dolt") == ("q", 3.5)
    assert clause("i will hurt you") == ("H", 4.0) or clause("i will hurt you")[0] == "K"
    assert clause("you should die")[0] == "K" and clause("they burn wood") is None and clause("a dolt and a dolt and a dolt") == ("I", 5.0)


def test_toxicity_of_clauses(spark):
    """The same insult, directed in toxic texts and denied or quoted in others: words alone cannot tell them, the grammar does."""
    rows, marks = [], []
    for k in range(900):
        said = (["you are a dolt", "they are all dolt", "your face dolt"], ["she said he was a dolt", "it is not a dolt", "never call it dolt"])[k % 2][k // 2 % 3]
        rows.append((k, f"{prose(k, 20)} {said}. {prose(k + 1, 20)}", "en", "a", 1))
        marks.append((k, 1 - k % 2))
    rows += [(1000 + k, prose(k, 40), "en", "a", 1) for k in range(900)]
    marks += [(1000 + k, 0) for k in range(900)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    table = np.zeros(toxicity.CELLS)
    table[np.unique(toxicity.cells("dolt")[1])] = 5.0
    truth = dict(marks)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    w = toxicity.fit(np.array([toxicity.features(r[1], table) for r in train]), np.array([truth[r[0]] for r in train], float))
    got = [r for r in toxicity.scores(docs, (table, w)).collect() if r.held_out]
    assert len(got) > 200 and sum(r.predicted == truth[r.doc_id] for r in got) >= 0.98 * len(got)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_licenses_by_force(seed):
    """Notices with words dropped, changed or put in, against the longest common subsequence in every stretch."""
    import random

    r = random.Random(seed)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, 2.0)
    for _ in range(8):
        name = r.choice(sorted(licenses.TEMPLATES))
        words = licenses.TEMPLATES[name].split()
        for _ in range(r.randrange(0, 1 + len(words) // 4)):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], ["zz"], [words[at], "qq"]])
        text = f"{prose(r.randrange(999), 15)} {' '.join(words)} {prose(r.randrange(999), 15)}"
        plain = licenses.normal(text)
        want = set()
        for k, template in scanner.words.items():
            reach = int(2.0 * len(template))
            if max(lcs(plain[i : i + reach], template) for i in range(max(1, len(plain) - reach + 1))) >= 0.8 * len(template):
                want.add(k)
        assert {x[0] for x in scanner.candidates(text)} == want, (name, text)
        got = scanner.scan(text)
        assert (got[0] in want and set(got[5]) <= want) if want else got[0] is None
