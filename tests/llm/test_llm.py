import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import hold  # noqa: E402

from scholia.llm import bpe, chat, decontam, passages, quality, simhash, sites, tokencount, urls, warc  # noqa: E402
from scholia.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, pos int"


def words(n, seed):
    own = random.Random(seed)
    return " ".join("".join(own.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), "x", 1) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    docs = documents(spark, None, "", " \n\t", "one", "long " * 30_000, words(80, 1), words(80, 1), "ÀÉ <|endoftext|>   ü" * 40)
    return docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    hold(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    own = random.Random(3)
    texts = ["".join(own.choice("abcdeth in's’,.\n\t  éß你12½<|endoftext|>") for _ in range(own.randint(0, 80))) for _ in range(500)]
    docs = documents(spark, *texts, None, "<|endoftext|>", "a" * 5000)
    found = {r.doc_id: r for r in bpe.digests(docs).join(tokencount.token_counts(docs).withColumnRenamed("n_tokens", "n2"), "doc_id").collect()}
    for i, t in enumerate([*texts, "", "<|endoftext|>", "a" * 5000]):
        ids = library.encode(t, add_special_tokens=False).ids
        assert found[i].n_tokens == found[i].n2 == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs)).where("coalesce(text, '') <> decoded")
    assert back.count() == 0


def test_simhash_against_brute_force(spark):
    own = random.Random(5)
    base = [own.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << own.randrange(64) for _ in range(own.randint(0, 4))) for b in base for _ in range(8)})
    signed = [int(np.array(f % (1 << 64), np.uint64).view(np.int64)) for f in fps]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == want
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd(spark)).collect()}
    assert rows[6] == 5 and rows[0] == rows[1] == rows[2] == 0 and None not in rows


def test_fingerprints_and_groups_against_brute_force(spark):
    import xxhash

    own = random.Random(6)
    base = [[own.choice("abcdefgh") * own.randint(1, 4) for _ in range(own.randint(0, 60))] for _ in range(30)]
    texts = [" ".join(b[:k] + ["New"] + b[k:]) for b in base for k in (0, len(b) // 2, len(b))] + [" ".join(b) for b in base] + ["\u00a0a\tB\x0bc", "A b"]
    want = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    lead = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (want[i] ^ want[j]).bit_count() <= 3:
                    lead[i] = min(lead[i], lead[j])
    rows = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(documents(spark, *texts)).collect()}
    assert rows == {i: (int(np.array(f, np.uint64).view(np.int64)), lead[i]) for i, f in enumerate(want)}


def test_similar_texts_against_brute_force(spark):
    """Groups by five-word shingles: no wrong link, and nearly all pairs of 0.8 or more together."""
    own = random.Random(7)
    texts = []
    for k in range(40):
        base = words(own.randint(80, 300), 300 + k).split()
        texts.append(base)
        for _ in range(3):
            new = list(base)
            for at in own.sample(range(len(new)), own.randint(0, max(1, len(new) // 60))):
                new[at] = f"n{own.randrange(1000)}"
            texts.append(new)
    texts += [words(3, 1).split(), words(3, 1).split(), words(2, 2).split(), [], []]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    lead = {r.doc_id: r.lead for r in simhash.similar(documents(spark, *map(" ".join, texts))).collect()}
    assert sum(lead[i] == lead[j] for i, j in pairs) >= 0.9 * len(pairs) and len(pairs) > 100
    group = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    assert all(group[i] == group[lead[i]] for i in lead)
    left = simhash.keep_one(odd(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in left) == [(False, d) for d in (0, 3, 4, 5, 5, 7)] + [(True, None)]


def test_thresholds_follow_the_pigeonhole_principle():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500)
    plan = simhash.allocate(1000, both, 3)
    dropped = 64 - sum(len(p) for p, _ in plan)
    assert dropped >= 0 and all(0 <= t <= 3 for _, t in plan)


def test_passages_found_and_removed(spark):
    p, q = words(90, 7), words(60, 8)
    changed = " ".join(w if i % 20 != 10 else "changed" for i, w in enumerate(p.split()))
    docs = documents(spark, words(100, 10) + " " + p, words(70, 11) + " " + changed + " " + words(30, 12), q + " " + words(40, 13), words(20, 14) + " " + q, words(200, 15))
    found = passages.passages(docs).collect()
    assert {(r.doc_id, r.other_doc_id) for r in found} == {(1, 0), (3, 2)}
    assert all(abs(r.n_words - n) <= 6 for r in found for n in [90 if r.doc_id == 1 else 60])
    left = {r.doc_id: r for r in passages.deduplicated(docs).collect()}
    assert len(left) == 5 and "changed" not in left[1].text and left[0].text.endswith(p) and left[3].n_chars == len(left[3].text)
    assert {r.doc_id for r in passages.passages(odd(spark)).collect()} == {6}


@pytest.mark.parametrize("gap", [30, 60, 100, 500, 2000])
def test_two_passages_of_one_pair(spark, gap):
    n = max(52, gap)  # words of each passage: enough that the chain joins them over the gap, too few to agree with it
    p, q = words(n, 40), words(n, 41)
    docs = documents(spark, " ".join([p, words(gap, 42), q]), " ".join([p, words(gap, 43), q]), words(90, 44))
    found = sorted((r.start_word, r.n_words) for r in passages.passages(docs).collect() if (r.doc_id, r.other_doc_id) == (1, 0))
    assert len(found) == 2 and all(abs(a - b) <= 3 for got, want in zip(found, [(0, n), (n + gap, n)]) for a, b in zip(got, want))


def test_passage_of_one_line_again_and_again(spark):
    line = " ".join([words(12, 50)] * 100)
    docs = documents(spark, words(300, 51) + " " + line + " " + words(300, 52), words(150, 53) + " " + line + " " + words(200, 54))
    (found,) = passages.passages(docs).collect()
    assert abs(found.start_word - 150) <= 3 and abs(found.n_words - 1200) <= 6 and abs(found.other_start - 300) <= 3


def shared_words(seed):
    own = random.Random(seed)
    return ["".join(own.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def test_passage_hidden_by_parts_in_other_texts(spark):
    p, other = shared_words(70)[:100], lambda k, n: words(n, 700 + k)
    cuts = [(0, 45), (30, 75), (60, 100)]
    texts = {k: [other(k, 30), " ".join(p[a:b]), other(k + 50, 20)] for k, (a, b) in enumerate(cuts)}
    texts |= {k + 13: [other(k + 13, 30), " ".join(p[a:b]), other(k + 63, 20)] for k, (a, b) in enumerate(cuts)}
    texts |= {10: [other(10, 40), " ".join(p), other(60, 9)], 19: [other(19, 12), " ".join(p), other(69, 40)]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    found = [(r.doc_id, r.other_doc_id, r.start_word, r.n_words) for r in passages.passages(docs).collect()]
    assert found == [(19, 10, 12, 100)]


def test_passage_is_not_cut_where_it_agrees_less(spark):
    p = shared_words(71)[:360]
    changed = p[:60] + [w if k % 7 else "other" for k, w in enumerate(p[60:], 1)]
    docs = documents(spark, words(30, 72) + " " + " ".join(p) + " " + words(50, 73), words(130, 74) + " " + " ".join(changed) + " " + words(150, 75))
    (found,) = passages.passages(docs).collect()
    assert found.n_words >= 358 and found.identity > 0.85


@pytest.mark.parametrize("kind, least", [("exact", 1.0), ("every fifth", 0.9), ("random", 0.9), ("dropped", 1.0)])
def test_passage_recall(spark, kind, least):
    """Planted passages of 50 words and more, words as frequent as in texts; a passage counts if nine tenths of it are named."""
    own = random.Random(80)
    known = ["".join(own.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    some = lambda n: own.choices(known, [1 / (k + 5) for k in range(3000)], k=n)
    rows, planted = [], []
    for i in range(60):
        n = 50 if kind == "exact" else 60
        p = some(n)
        q = {"exact": p, "every fifth": [w if k % 5 != 2 else f"x{k}" for k, w in enumerate(p)], "dropped": [w for k, w in enumerate(p) if k % 13 != 6], "random": list(p)}[kind]
        if kind == "random":
            for k in own.sample(range(1, n - 1), n // 5):
                q[k] = f"y{k}"
        before = own.randint(0, 150)
        rows += [(2 * i, " ".join(some(own.randint(0, 150)) + p + some(40))), (2 * i + 1, " ".join(some(before) + q + some(own.randint(0, 80))))]
        planted.append((2 * i + 1, before, len(q)))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = 0
    for doc, start, n in planted:
        named = {k for r in got if r.doc_id == doc for k in range(r.start_word, r.start_word + r.n_words)}
        hit += len(named & set(range(start, start + n))) >= 0.9 * n
    assert hit / len(planted) >= least


def test_leaks_against_brute_force(spark):
    """All pairs of texts and items by the longest common subsequence over windows, answers included."""
    own = random.Random(90)
    items, texts = [], []
    for i in range(12):
        question = shared_words(900 + i)[: own.randint(20, 60)]
        items.append((i, " ".join(question) + ". " + words(5, 950 + i) + "."))
        whole = items[-1][1].split()
        for share, said in ((0.9, True), (0.7, True), (0.7, False), (0.4, True)):
            kept = [w if own.random() < share + 0.04 else "zz" for w in question]
            texts.append(words(own.randint(0, 60), 990 + len(texts)).split() + kept + (whole[len(question) :] if said else []) + words(30, 1500 + len(texts)).split())
    items += [(20, "one two three"), (21, "alpha beta gamma delta epsilon")]
    texts += ["one two three".split(), "zero one two three".split(), "x alpha beta gamma delta epsilon y".split()]
    clean = lambda ws: [w.strip(".") for w in ws]
    want, close = set(), set()
    for i, item in items[:12]:
        w = clean(item.split())
        tail = clean(item.split(". ")[1].split())
        for d, text in enumerate(texts):
            t = clean(text)
            best = max((decontam.lcs([hash(x) for x in w], [hash(x) for x in t[a : a + len(w) + 16]]) / len(w) for a in range(0, len(t), 8)))
            holds = best >= 0.75 or (best >= 0.6 and decontam.lcs([hash(x) for x in tail], [hash(x) for x in t]) >= 0.9 * len(tail))
            (want if holds else close).add((d, i)) if holds or best >= 0.5 else None
    want |= {(48, 20), (50, 21)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark, *map(" ".join, texts)), benchmark).collect()}
    assert len(want & found) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want) + 1
    assert {(48, 20), (50, 21)} <= found and not {(49, 20)} & found
    assert decontam.leaks(odd(spark), benchmark).count() == 0


def test_leaks_found(spark):
    items = [(i, words(30, 100 + i) + ". " + words(6, 200 + i) + ".") for i in range(5)] + [(9, None), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    nearly = " ".join(w if i % 9 != 4 else "other" for i, w in enumerate(items[1][1].split()))
    docs = documents(spark, words(50, 1) + " " + items[0][1] + " " + words(50, 2), words(33, 3) + " " + nearly, words(300, 4), None, "")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == {(0, 0), (1, 1)}
    assert decontam.clean(docs, benchmark).columns == docs.columns
    assert decontam.leaks(odd(spark), benchmark.limit(0)).count() == 0


def test_leaks_of_frequent_words(spark):
    """Over 2000 passages; the items have only words that stand in more than one passage of 20."""
    own, frequent = random.Random(60), words(10, 60).split()
    texts = [[own.choice(frequent) if own.random() < 0.2 else w for w in words(48, 1000 + i).split()] for i in range(500)]
    items = [(i, " ".join(own.choice(frequent) for _ in range(24))) for i in range(20)]
    for i, text in items:
        texts[10 * i][i : i] = text.split()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(documents(spark, *map(" ".join, texts)), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.lcs == 1} == {(10 * i, i) for i in range(20)}


def test_classifier_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = sites.classified(docs, train).join(test, "doc_id").select(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), "kept").toPandas()
    assert (got.good == got.kept).mean() > 0.9
    assert sites.classified(odd(spark), labels).count() == 10
    assert sites.classified(odd(spark), labels.limit(0)).where("not kept").count() == 0


def test_site_posteriors_by_hand(spark):
    rows = [("a", "x", 0.9), ("a", "x", 0.7), ("a", "y", 0.1), ("b", "x", 0.2), ("b", None, 0.4), (None, "x", 1.0)]
    found, mean = sites.sites(spark.createDataFrame(rows, "host string, path string, good double"))
    from collections import defaultdict

    n, s, hn, hs = defaultdict(int), defaultdict(float), defaultdict(int), defaultdict(float)
    for h, p, g in rows:
        n[h, p] += 1
        s[h, p] += g
        hn[h] += 1
        hs[h] += g
    m = sum(hs.values()) / len(rows)
    weight = lambda sizes, sums, prior: m * (1 - m) / max((sum(sizes[k] * (sums[k] / sizes[k] - prior(k)) ** 2 for k in sizes) - len(sizes) * m * (1 - m)) / max(len(rows) - sum(v * v for v in sizes.values()) / len(rows), 1.0), 1e-4)
    k = weight(hn, hs, lambda _: m)
    host = {h: (hs[h] + k * m) / (hn[h] + k) for h in hn}
    k = weight(n, s, lambda hp: host[hp[0]])
    assert abs(mean - m) < 1e-9
    for r in found.collect():
        assert abs(r.host_mean - host[r.host]) < 1e-9
        assert abs(r.path_mean - (s[r.host, r.path] + k * host[r.host]) / (n[r.host, r.path] + k)) < 1e-9


def test_quality_bands_by_hand(spark):
    own = random.Random(11)
    texts = [words(own.randint(60, 90), 400 + i) for i in range(30)] + ["the quick brown fox jumps over a lazy dog " + words(50, 500), "\u4e00\u9fa5\u3400 " * 3 + " ".join(chr(0x13000 + i) for i in range(60))]
    rows = quality.judged(documents(spark, *texts)).collect()
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        good = [r for r in mine if not r.base_failed]
        for r in mine:
            inside = not r.base_failed
            for m, (low, high, least) in quality.BANDS.items():
                v = sorted(round(x[m], 4) for x in good)
                q1, q3 = (v[-(-len(v) * p // 4) - 1] for p in (1, 3)) if v else (0, 0)
                reach = 4.0 * max(q3 - q1, least)
                inside &= not (low and r[m] < q1 - reach) and not (high and r[m] > q3 + reach)
            assert r.kept == inside


def test_quality_against_brute_force(spark):
    import re
    from collections import Counter

    docs = odd(spark).unionByName(documents(spark, "a b c\na b c\n\na b c d # $", words(60, 1) + "\n" + words(60, 2)).withColumn("doc_id", F.col("doc_id") + 20))
    for r, t in ((r, r.text or "") for r in quality.measure(docs).join(docs.select("doc_id", "text"), "doc_id").distinct().collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    assert quality.judged(docs).count() == docs.count()


def test_warc_revisits(spark):
    from collections import Counter

    long = "<p>é\r\n\r\n</p>" * 5000
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", long), (None, "u", "z"), (5, "u", long), (7, "q", "aaa"), (7, "q", "bbb"), (8, "q", "bbb"), (None, "v", "z"), (9, "v", "z")]
    rows = [(*r, "x", i) for i, r in enumerate(rows + [(10, "w", "often")] * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, page int")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages).collect())
    n = len(long.encode())
    want = [(1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, n, "response", None), (5, n, "revisit", 5)]
    want += [(None, 1, "revisit", 9)] * 2 + [(9, 1, "response", None), (7, 3, "response", None), (7, 3, "response", None), (8, 3, "revisit", 7), (10, 5, "response", None)] + [(10, 5, "revisit", 10)] * 39
    assert got == Counter(want)
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip
    import zlib

    pages = spark.createDataFrame([(i, f"http://h/{i}", "é<p>" * (i % 7)) for i in range(60)], "page_id long, url string, html string")
    heads = warc.resolved(warc.written(warc.headers(pages), "t"))
    warc.write(pages, heads, str(tmp_path / "w"), per_file=25)
    seen = 0
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        assert len(data) == 0 or gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        while data:  # each record in a member of its own
            one = zlib.decompressobj(31)
            record, data = one.decompress(data), one.unused_data
            seen += record.count(b"WARC/1.1\r\n")
            assert record == b"" or record.count(b"WARC/1.1\r\n") == 1 and record.endswith(b"\r\n\r\n")
    assert seen == 60


def test_chat_snapshots(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, None, None, None), (4, None, None, None), (None, 0, "user", "z")]
    got = chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(2, 2), (4, 1)}


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "x.net/es/"), (4, None), (5, "http://b.net/es/1"), (6, "http://notcom/")], "page_id long, url string")
    pages = pages.withColumn("html", F.lit(None).cast("string")).withColumn("n", F.lit(1))
    pages = pages.unionByName(pages.where("page_id = 6"))
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = urls.judged(pages, docs, labels).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == 7
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("", "", None, "allow") == got[4] and got[5][2:] == ("net/es/", "block") and got[6][2] is None
    assert urls.judged(pages.limit(0), docs, labels).count() == 0


def test_url_templates_of_bad_branches(spark):
    docs = spark.createDataFrame([(i, "bad evil spam words" if i % 2 else "good nice clean words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    deep = [(f"/a/b/c/d/e/{branch}/{i}", text) for i in range(60) for branch, text in (("casino", "evil spam"), ("news", "nice good"), ("sport", "nice clean"))]
    slugs = [(f"/u/slug{chr(97 + i % 26)}{chr(97 + i // 26)}", "nice good") for i in range(300)] + [(f"/u/spam/{i}", "evil bad") for i in range(60)]
    rows = [(k, f"http://h.example.org{path}", f"<p>{text}</p>") for k, (path, text) in enumerate(deep + slugs + [("/" + "/".join("x" * 60), "nice")])]
    found = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), docs, labels, []).collect()
    for r in found:
        assert (r.verdict == "block") == ("casino" in r.path or "/spam/" in r.path)
    assert {r.template for r in found if r.path.startswith("/u/")} == {"/u/*", "/u/spam/*"}


def test_empty_tables(spark):
    docs, labels = documents(spark).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, words(20, 1))], "item_id long, text string")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for found in (decontam.leaks(docs, benchmark), decontam.clean(docs, benchmark), passages.passages(docs), passages.deduplicated(docs), sites.classified(docs, labels), sites.kept(docs, labels), chat.rendered(talks), simhash.near_duplicates(docs), simhash.keep_one(docs), quality.judged(docs), bpe.digests(docs), tokencount.token_counts(docs)):
        assert found.count() == 0


def test_chat_of_odd_conversations(spark):
    long = "long " * 50_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (2, 0, "user", long), (2, 1, None, None), (3, 5, "user", "")]
    talks = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, n string, h1 int")
    got = {r.conv_id: r for r in chat.rendered(talks).collect()}
    assert set(got) == {2, 3} and got[2].n_turns == 2 and long in got[2].rendered and "unknown" in got[2].rendered


def test_pipeline_stages(spark):
    """What each stage takes out and what it leaves."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = stages["quality classifier"](spark, docs, "/root/testdata/sf0.01")
    sure = labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).join(good.select("doc_id", F.lit(True).alias("in")), "doc_id", "left").toPandas()
    assert sure[sure.good]["in"].notna().mean() > 0.95 and sure[~sure.good]["in"].notna().mean() < 0.3
    base, p = words(200, 600).split(), words(70, 601)
    near = " ".join(base[:100] + ["new"] + base[101:])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    made = documents(spark, " ".join(base), near, " ".join(base), words(90, 602) + " " + p, words(90, 603) + " " + p, words(90, 604) + " " + item, words(150, 605), None, "")
    one = stages["SimHash near-dedup"](spark, made, SF)
    assert {r.doc_id for r in one.collect()} == {0, 3, 4, 5, 6, 7}
    cut = stages["substring dedup"](spark, made.where("doc_id >= 3"), SF).collect()
    assert {r.doc_id for r in cut} == {3, 4, 5, 6, 7, 8} and [r.doc_id for r in cut if r.text and p in r.text] == [3]
    assert {r.doc_id for r in stages["benchmark decontamination"](spark, made, SF).collect()} == {0, 1, 2, 3, 4, 6, 7, 8}
    for name in list(stages)[:-1]:
        assert stages[name](spark, odd(spark), SF).columns == odd(spark).columns


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0
