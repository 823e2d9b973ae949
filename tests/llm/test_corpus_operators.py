"""Each corpus operator against a brute-force version, on a small table and on odd rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import decontaminate, induced, license_scan, line_dedup, mixing, near_dedup, quality, queries, substring_dedup, token_count, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, bucket int, node int"


def odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long_ = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    p = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty and more"
    rows = [
        (None, "a text without an id that goes on", "en", "s0"), (1, None, "en", "s0"), (2, "", None, None), (3, "   \n\t ", "en", "s1"), (4, "word", "en", "s1"), (5, "Word", "en", None),
        (6, p, "en", "s2"), (7, f"intro\n{p}\noutro", "en", "s2"), (7, f"intro\n{p}\noutro", "en", "s2"), (8, f"{p}\n{p}", "de", "s0"), (9, long_, "en", "s0"), (10, long_ + " end", "en", "s1"),
        (11, "İstanbul ÇA ß ﬁ \u0000 zero <|endoftext|> it's they'LL 123 日本語 !!!'s", "xx", "s2"), (12, " nbsp em space\u000bvt", "en", "s1"),
    ]
    return spark.createDataFrame([(*r, 0, "x", 5, 6, 7) for r in rows], SCHEMA)


def both(spark, docs):
    return [docs, odd_rows(spark), spark.createDataFrame([], SCHEMA)]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(spark, docs):
    for table in both(spark, docs):
        rows = [(i, shingles(t)) for i, t in rows_of(table)]
        parent = {i: i for i, _ in rows if i is not None}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        known = [(i, s) for i, s in rows if i is not None and s]
        for k, (i, s) in enumerate(known):
            for j, t in known[:k]:
                n = len(s & t)
                if 100 * n >= 75 * (len(s) + len(t) - n):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        want = Counter((i, len(s), None if i is None else root(i), i is not None and root(i) == i) for i, s in rows)
        got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table).collect())
        assert got == want


def test_near_duplicate_group_around_an_original(spark):
    """Edited copies of one text link to it alone, so only the original joins them."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        w = list(base)
        for at in rng.choice(60, 7, replace=False):
            w[at * 5] = f"k{k}n{at}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    linked = sum(100 * len(sets[k] & sets[500]) >= 75 * len(sets[k] | sets[500]) for k in range(60))
    out = near_dedup.near_duplicates(df).collect()
    assert linked > 50 and sum(r.component_id == 0 for r in out) >= linked


@pytest.mark.parametrize("size,block,most", [(60, 2048, 8), (700, 2048, 8), (60, 16, 100), (60, 16, 0)])
def test_near_duplicates_without_one_original(spark, size, block, most, monkeypatch):
    """Copies with different amounts of edits: many link only through others, many not at all; bundled whole, by blocks, and by buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MOST", most)
    monkeypatch.setattr(near_dedup, "SMALL", min(block, near_dedup.SMALL))
    rng = random.Random(size)
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, size // 12)):
            words[rng.randrange(size)] = f"e{i}x{rng.randrange(9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if low[a] != low[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    out = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(low))


def test_near_duplicates_of_repeated_ids(spark):
    """Texts that share a doc_id belong together, and each of them links to its own near copies."""
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(80))
    rows = [(7, text("a")), (7, text("b")), (8, text("a") + " x"), (9, text("b") + " y"), (3, text("c")), (10, text("c")), (11, text("d")), (None, text("d")), (None, text("d")), (12, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (3, 3, True), (10, 3, False), (11, 11, True), (None, None, False), (None, None, False), (12, 12, True)])


def test_drop_near_duplicates_repeated_rows(spark):
    """Equal rows leave one; of two texts with one doc_id only the near copy goes."""
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(80))
    rows = [(1, text("a"), "x"), (1, text("a"), "x"), (2, text("a") + " end", "x"), (2, text("b"), "y"), (3, text("c"), "y"), (3, text("c"), "y"), (None, text("d"), "z"), (4, None, "z"), (4, None, "z")]
    want = Counter([(1, text("a")), (2, text("b")), (3, text("c")), (4, None), (None, text("d"))])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns and Counter(rows_of(out)) == want
    # Repeated rows alone, without several texts to an id.
    df = df.where("NOT (doc_id = 2 AND source = 'x') OR doc_id IS NULL")
    assert Counter(rows_of(near_dedup.drop_near_duplicates(df))) == want


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["plain <|endoftext|><|endoftext|> two", "<|startoftext|>", "é É e\u0301 ﬁ ﬀ ½ ² ª µ ß ẞ İ", "it\u2019s IT'S we'LL 'd'd ''s", "a\u00a0b\u2003c\x1cd\x85e\x0bf", "ÀÉÎÕÜ×÷ÿ Ñandú 12³", "日本語。テスト 🙂🙂 zwj\u200dx", "<|endoftext", "\x00\x07 bell", "x" * 3000]
    mixed = spark.createDataFrame([(i, x) for i, x in enumerate(odd)] + [(None, odd[0]), (3, odd[3])], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        for table in (*both(spark, docs), mixed) if name[0] == "w" else (mixed,):
            want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in rows_of(table))
            for most in (1_000_000, 30):
                assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(table, path, broadcast=most).collect()) == want


def brute_passages(text, least):
    """(start, end, words) of every unit, by the rule: whole sentences in a row, the fewest with so many words together."""
    parts, at = [], 0
    for end in [m.end() for m in re.finditer(r"(?:[.!?…]+[\"'”’»)\]]*[^\S\n]+|[。！？]+|\n+)", text)] + [len(text)]:
        words = [(at + m.start(), at + m.end(), m[0].lower().strip(string.punctuation) or m[0].lower()) for m in re.finditer(r"\S+", text[at:end])]
        if len(words) > 40:
            first, begin = 0, at
            for k, (_, e, w) in enumerate(words):
                last = k == len(words) - 1
                if last or xxhash.xxh64_intdigest(w) % 8 == 0:
                    parts.append((begin, end if last else e + 1, tuple(w for _, _, w in words[first : k + 1])))
                    first, begin = k + 1, end if last else e + 1
        elif words:
            parts.append((at, end, tuple(w for _, _, w in words)))
        at = end
    out = {}
    for a in range(len(parts)):
        end = next((b for b in range(a, len(parts)) if sum(len(p[2]) for p in parts[a : b + 1]) >= least), None)
        start = next((b for b in range(a, -1, -1) if sum(len(p[2]) for p in parts[b : a + 1]) >= least), None)
        for low, high in [(a, end)] * (end is not None) + [(start, a)] * (start is not None):
            out[low, high] = (parts[low][0], parts[high][1], tuple(p[2] for p in parts[low : high + 1]))
    return list(out.values())


def brute_line_dedup(rows, least):
    """(doc_id, text) -> the text that is left."""
    units, first, times = {}, {}, Counter()
    for row in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        units[row] = brute_passages(row[1] or "", least) if len(row[1] or "") < 60_000 else []
        for s, e, w in units[row]:
            times[w] += 1
            if w not in first or (first[w][0] == row and (s, e) < first[w][1:]):
                first[w] = (row, s, e)
    out = {}
    for row, found in units.items():
        gone = bytearray(len(row[1] or ""))
        for s, e, w in found:
            if first[w] != (row, s, e):
                s = max(s, first[w][2]) if first[w][0] == row else s
                gone[s:e] = b"\1" * max(0, e - s)
        out[row] = row[1] and "".join(c for c, g in zip(row[1], gone) if not g)
    return out


def test_line_dedup(spark, docs):
    for table in both(spark, docs):
        rows = [r for r in rows_of(table) if len(r[1] or "") < 60_000]
        for least in (4, 20):
            want = brute_line_dedup(rows, least)
            small = table.where("text IS NULL OR length(text) < 60000")
            for r in line_dedup.dedup_lines(small.withColumn("removed", F.lit(1)).withColumn("row", F.lit(2)), least).collect():
                assert r.kept_text == want[(r.doc_id, r.text)] and r["row"] == 2
                if r.text is not None:
                    assert r.kept_text == "".join(c for k, c in enumerate(r.text) if not any(s.start <= k < s.end for s in r.removed))
        assert line_dedup.remove_repeats(table.withColumn("removed", F.lit(1))).columns == [*table.columns, "removed"]


def test_line_dedup_whole_long_texts(spark):
    """Of two very long texts the later one goes but for its own end, with or without punctuation."""
    for stop in ("", "."):
        text = " ".join(f"w{i % 977}x{i}" + stop * (i % 11 == 0) for i in range(60_000))
        df = spark.createDataFrame([(2, text + " 5 own words at end"), (1, text)], "doc_id long, text string")
        got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(df).collect()}
        assert got[1] == text and len(got[2]) < 200 and got[2].endswith("own words at end")


def test_line_dedup_planted_passages(spark):
    """Passages of over 50 words that start inside a line, run over lines or are set in short ones go from the later documents; texts of their own stay."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join([word().capitalize(), *(word() for _ in range(n - 1))]) + "."
    prose = lambda n: " ".join(sentence(rng.randrange(3, 16)) for _ in range(n))
    plant = {
        "inside a line": prose(9), "over lines": "\n".join(prose(3) for _ in range(3)), "short lines": "\n".join(" ".join(word() for _ in range(6)) for _ in range(12)),
        "no punctuation": " ".join(word() for _ in range(120)), "blank lines": "\n\n".join(prose(2) for _ in range(5)),
    }
    rows, holds = [], {}
    for k, (kind, p) in enumerate(plant.items()):
        for i in range(4):
            doc = 10 * k + i
            rows.append((doc, f"{prose(4)} {p} {prose(3)}\n{prose(2)}" if kind != "no punctuation" else f"{prose(4)} {' '.join(word() for _ in range(5 + i))} {p} {' '.join(word() for _ in range(9 - i))}\n{prose(2)}"))
            holds[doc] = (kind, p, i)
    clean = [(1000 + i, f"{prose(8)}\nA short line that they share.\n{prose(3)}") for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    for doc, (kind, p, i) in holds.items():
        gone = sum(s.end - s.start for s in got[doc].removed)
        assert gone == 0 if i == 0 else len(p) * 0.7 <= gone <= len(p) + 2, (kind, i, gone, len(p))
    assert all(got[i].kept_text == t for i, t in clean)


def test_license_scan(spark, docs):
    mit = license_scan.LICENSES["MIT"]
    df = spark.createDataFrame([(1, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-licence") + "\n"), (3, mit + " more"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in license_scan.scan(df).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None}
    for table in both(spark, docs)[1:]:
        assert license_scan.scan(table).count() == table.count()


def test_license_scan_real_files(spark):
    """Wrapped texts with titles and holders, and the long licences; near misses and concatenations stay unknown."""
    import textwrap

    full = dict(license_scan.texts())
    # Statements of copyright are lines of their own in real files; all other paragraphs are wrapped anew.
    wrap = lambda t, n: "\n".join((x if re.search(r"(?i)copyright (\(c\)|\[)", x) else textwrap.fill(" ".join(x.split()), n)) + "\n" for x in t.split("\n\n"))
    rows, want = [], {}

    def add(text, license):
        want[len(rows)] = license
        rows.append((len(rows), text))

    for n in (40, 60, 72, 79, 200):
        for name, title in (("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"), ("Zlib", "zlib License")):
            add(f"# {title}\n\nCopyright (c) 2015-2020, A. Person <a@b.c>\nAll rights reserved.\n\n{wrap(license_scan.LICENSES[name], n)}", name)
        add("BSD 3-Clause License\n\n" + wrap(full["BSD-3-Clause"].replace("University", "Example Org"), n), "BSD-3-Clause")
        for name in ("Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "Unlicense", "BSD-2-Clause"):
            add(wrap(full[name], n), name)
    add(full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 Somebody"), "Apache-2.0")
    add(full["Apache-2.0"].split("   END OF TERMS")[0], "Apache-2.0")
    add(full["Apache-2.0"] + license_scan.LICENSES["MIT"], None)
    add(license_scan.LICENSES["MIT"].replace("WITHOUT WARRANTY", "WITH WARRANTY"), None)
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_url_filter(spark):
    urls = ["https://a.Example.ORG/es/1", "http://example.org/en/12?x", "http://org", "http://org/", "ftp://notexample.org/en/1", "http://x.com/fr/#y", "http://com/de/", "no url", "", None, "http://example.org?/es/", "http://u@b.example.org:80/es/", "http://example.org./es/"] * 2
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h")], "page_id long, url string, host string")
    for ranges in (1, 7):
        out = url_filter.judge(df, queries.RULES, ranges=ranges).collect()
        assert len(out) == len(urls) + 1
        for r in out:
            u = urls[r.page_id] if r.page_id is not None else urls[0]
            host = path = ""
            if u and "://" in u:
                host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", u.split("://", 1)[1]).groups()
                host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
            fits = [q for q in queries.RULES if (host == q[1] or host.endswith("." + q[1])) and path.startswith(q[2])]
            best = max(fits, key=lambda q: len(q[1] + q[2]), default=None)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[1] + best[2], best[0] if best else "allow")
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0


def test_url_filter_many_rules(spark):
    """Hundreds of nested rules of a few hosts, two verdicts for some: against all rules for every url."""
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randrange(0, 5)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(400)]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f', '/x'])}" for _ in range(600)]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, "none", ranges=5).collect()
    for r in out:
        fits = [q for q in rules if (r.host == q[1] or r.host.endswith("." + q[1])) and r.path.startswith(q[2])]
        best = min(fits, key=lambda q: (-len(q[1] + q[2]), -len(q[1]), q[0]), default=None)
        assert (r.rule, r.verdict) == ((best[1] + best[2], best[0]) if best else (None, "none"))
    assert len(out) == len(urls) and any(r.rule for r in out)


def test_toxicity(spark, docs, sf):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lexicon = toxicity.learn(big, labels)
    got = {r.doc_id: r for r in toxicity.score(big, lexicon).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p for p, y in held if not y) <= 0.03 * sum(not y for _, y in held)
    assert sum(p for p, y in held if y) >= 0.5 * sum(y for _, y in held)
    for table in both(spark, docs)[1:]:
        assert toxicity.score(table, lexicon).count() == table.count()
        assert toxicity.drop_toxic(table, labels).columns == table.columns
    assert toxicity.fold("Ιdi0t — 1DIOT ѕtupіd 2024") == ["idiot", "idiot", "stupid", "2024"]
    assert not toxicity.learn(big, labels.where("toxic = 0")).fitted


def plain_fold(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip(" ")


def plain_edits(item, text, most):
    """Least edits that turn the item into a stretch of the text: the whole table, row by row; most + 1 if there is none."""
    if item in text:
        return 0
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[j - 1] + 1))
        row = new
        if min(row) > most:
            return most + 1
    return min(min(row), most + 1)


def test_decontamination_against_the_whole_table(spark):
    """Edited copies of items with letters of any script, at the edges of texts and inside them."""
    rng = random.Random(8)
    letters = "abcdeéèßñ日語жλ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(8, 22)))) for k in range(12)] + [(50, "abc"), (51, None), (52, "Ünïcode — “quoted”, words…  and  MORE words here")]
    texts = []
    for k in range(70):
        item = list(rng.choice(items)[1] or "x")
        for _ in range(rng.randrange(0, max(2, len(item) // 7))):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(0, 2)] = rng.choice(["", "é", "q", "日 "])
        around = [" ".join(word() for _ in range(rng.randrange(0, 20))) for _ in range(2)]
        texts.append((k, rng.choice([" ", " — ", "\n"]).join([around[0], "".join(item), around[1]])))
    texts += [(80, None), (81, ""), (82, "ünïcode 'quoted' words and more words here!"), (83, "b" * 30)]
    want, near = {}, 0
    for d, t in texts:
        found = {}
        for i, x in items:
            f, e = plain_fold(x), max(0, min(len(plain_fold(x)) // 10, (len(plain_fold(x)) - 8) // 8))
            if len(f) >= 8 and (n := plain_edits(f, plain_fold(t), e)) <= e:
                found[i] = n
        near += any(found.values())
        want[d] = (sorted(found), min(found.values(), default=None))
    got = {r.doc_id: (list(r["items"]), r.least_edits) for r in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and near > 15 and want[82] == ([52], 0)


def test_decontamination(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = np.random.default_rng(3)
    item = items[0][1]
    edited = list(item)
    for at in rng.choice(len(item), len(item) // 20, replace=False):
        edited[at] = "z"
    planted = spark.createDataFrame([(10_001, "before " + "".join(edited) + " after"), (10_002, item.upper() * 2), (10_003, " ".join(f"q{i}" for i in range(700_000)) + item)], "doc_id long, text string")
    for table in [docs.select("doc_id", "text").union(planted), *both(spark, docs)[1:]]:
        got = {r.doc_id: (r.contaminated, set(r["items"]), r.least_edits) for r in decontaminate.find_leaks(table, bench).collect()}
        for i, t in rows_of(table):
            # Whole copies at least, in texts of any length.
            assert {k for k, x in items if len(plain_fold(x)) >= 8 and plain_fold(x) in plain_fold(t)} <= got[i][1] and got[i][0] == bool(got[i][1])
        if 10_001 in got:
            assert items[0][0] in got[10_001][1] and got[10_002][2] == 0 and items[0][0] in got[10_003][1]
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def brute_quality(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for table in both(spark, docs):
        want = Counter((i, *(s := brute_quality(t)), s[0] < 20 or 100 * s[4] > 30 * s[0]) for i, t in rows_of(table))
        out = quality.judge(table, labels).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
        assert not any(r.kept and r.base_failed for r in out)


def test_quality_threshold(spark):
    """Most rows of quality 0 that pass the base rules go, few of quality 1; labels that say nothing reject nothing."""
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    kept = {q: [r.kept for r in out if not r.base_failed and labels.get(r.doc_id) == q] for q in (0, 1)}
    assert len(kept[0]) > 20 and sum(kept[0]) <= 0.1 * len(kept[0]) and sum(kept[1]) >= 0.95 * len(kept[1])
    rng = np.random.default_rng(0)
    bad, good = rng.normal(5, 1, 300), rng.normal(15, 1, 3000)
    noisy = quality.threshold(np.concatenate([good[90:], bad[:60]]), np.concatenate([bad[60:], good[:90]]))
    assert (bad < noisy).mean() > 0.99 and (good >= noisy).mean() > 0.99
    assert quality.threshold(np.arange(50.0), np.arange(50.0)) == quality.threshold(good, bad[:0]) == float("-inf")


def brute_spans(rows, length=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - length + 1):
                g = b[k : k + length]
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits,shard", [(1 << 29, 3 << 20), (1 << 20, 20_000)])
def test_substring_dedup(spark, docs, bits, shard):
    for table in both(spark, docs):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_substrings(table, bits, shard).collect())
        assert got == brute_spans(rows_of(table))


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n, k in ((0, 2), (1, 2), (2, 2), (50, 1), (300, 2), (2000, 3), (5000, 200)):
        t = rng.integers(0, k, n).astype(np.uint8)
        sa = induced.suffix_order(t, 50)
        assert sorted(sa) == list(range(n))
        b = t.tobytes()
        keys = [b[i : i + 50] for i in sa]
        assert keys == sorted(keys)


def brute_targets(sizes, weights=mixing.WEIGHTS):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while len(full) < len(names):
        rest = total - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}
    return full


def test_mixing(spark, docs):
    for table in both(spark, docs):
        sizes, sources = defaultdict(int), {}
        for r in table.select("doc_id", "text", "source").collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        target = brute_targets(sizes)
        out = mixing.mix(table).collect()
        assert len(out) == table.count()
        assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(table.repartition(3)).collect()))
        taken, biggest = defaultdict(int), defaultdict(int)
        for r in out:
            s = (r.source_size, round(r.target, 6))
            assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
            taken[s] += r.taken
            biggest[s] = max(biggest[s], r.size)
        want = defaultdict(float)
        for s in sizes:
            want[(sizes[s], round(target[s], 6))] += target[s]
        assert set(want) == set(taken)
        for s in taken:
            assert abs(taken[s] - want[s]) <= biggest[s] + 1e-6


def test_mix_is_materialised(spark, docs):
    out = mixing.take_mix(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("copies").alias("copies")).collect()
    assert out and all(r.n == r.copies for r in out)


def test_mix_takes_every_row(spark):
    """Rows without or with repeated doc_ids have copies of their own: what is taken meets the target."""
    rows = [(None if i % 3 == 0 else i // 4 if i % 3 == 1 else i, " ".join(f"w{i}x{k}" for k in range(10 + i % 2)), f"s{i % 3 + i % 2}") for i in range(600)]
    df = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, source string")
    sizes, taken = Counter(), Counter()
    for _, t, s in rows + rows[:30]:
        sizes[s] += len(t.split())
    out = mixing.take_mix(df).collect()
    for r in out:
        assert r.size == len(r.text.split()) and 1 <= r.copy <= r.copies
        taken[r.source] += r.size
    assert all(abs(taken[s] - target) <= 11 for s, target in brute_targets(sizes).items())
    assert any(r.doc_id is None for r in out)
    again = mixing.take_mix(df.repartition(5)).groupBy("doc_id", "text", "source").count()
    assert Counter(map(tuple, again.collect())) == Counter((*k, n) for k, n in Counter((r.doc_id, r.text, r.source) for r in out).items())


@pytest.mark.parametrize("budget", [60, 400, 1 << 20])
def test_suffix_queue_least_owner(budget):
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 40).astype(np.uint8).tobytes()
    texts = [base[s : s + n] for s, n in zip(rng.integers(0, 20, 60).tolist(), rng.integers(5, 25, 60).tolist())]
    owners = rng.permutation(60).tolist()
    queue = induced.SuffixQueue(8, budget)
    for t, o in zip(texts, owners):
        queue.add(t, o)
    first = {}
    for t, o in zip(texts, owners):
        for k in range(len(t) - 7):
            first[t[k : k + 8]] = min(o, first.get(t[k : k + 8], o))
    assert [x.tolist() for x in queue.least()] == [[first[t[k : k + 8]] for k in range(len(t) - 7)] for t in texts]
