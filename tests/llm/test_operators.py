"""The operators against plain single-machine versions, on given rows and on awkward ones."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

from docspark.llm import decontaminate, language, packing, private, pu, queries, quotes, rules, sharding, simhash, substrings

CLASH = ["row", "text_hash", "spans", "t", "terms", "doc", "node", "other_id", "__id", "__hash", "__t", "__spans", "__row", "__email"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, mask long, rank int, " + ", ".join(f"`{c}` string" for c in CLASH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(200), say(60)
    edited = base.split()
    edited[50] = "changed"
    return [
        None, "", " \n\t ", "one", "Two WORDS", "İstanbul ² ΣΣ naïve 中文 ١٢ <|endoftext|> it's 'S 12 a_b", base, base, " ".join(edited), base.upper(), say(30) + "\n" + passage + "\n" + say(40),
        passage + " " + say(20), passage[7:] + say(9), "x" * 5000, "ab" * 400, say(9000), "a b " * 900, "line\nline\n\nline\n" * 30, "&&& ### $$ " * 40,
        "mail a@b.co, a@b.c%d@e.f.g x@y z@w-1.org. 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 004111 4111 1111 1111 1111 4111-1111-1111-1112 +1 (415) 555-0123 +12 3 ++33 1 23 45 67 89.",
        "éé café@x.io \U0001f600 b@c.de 192.168.0.255 +49 30 1234567 ", "@@@ +++ ... --- 1 2 3", "a" * 3000 + "@" + "b." * 50, "1" * 2000, "+" + "(" * 2000,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    clash = tuple(f"own {c}" for c in CLASH)
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t or ""), "clash", 1, 2, *clash) for i, t in enumerate(awkward_texts())]
    rows += [rows[6], rows[6], (None, "no id at all, " * 9, None, None, None, None, None, None, *clash), (None, rows[6][1], "en", "s", 1, "", 0, 0, *clash)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- 2


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(prints, distance=3):
    """Over (id, fingerprint): the smallest id of each one's component, by comparing all."""
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[top(i)].append(doc)
    return [min(least[top(i)], default=None) for i in range(len(prints))]


@pytest.mark.parametrize("which", ["docs", "given"])
def test_simhash(which, request, spark):
    df = request.getfixturevalue(which)
    prints = [(d, plain_fingerprint(t)) for d, t in pairs(df)]
    want = Counter((d, f, c) for (d, f), c in zip(prints, plain_components(prints), strict=True))
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_simhash_groups_are_split_and_exact(spark):
    r = random.Random(1)
    center = r.getrandbits(64)
    fps = {center}
    while len(fps) < 400:  # a ball around one fingerprint, and some that are far
        x = center if r.random() < 0.6 else r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    rows = [(simhash._signed(f), i) for i, f in enumerate(sorted(fps))]
    want = plain_components([(i, f & (2**64 - 1)) for f, i in rows])
    for limit in (8192, 40, 3):
        to = {x["node"]: x["component"] for x in simhash.components(simhash.links(spark.createDataFrame(rows, "fp long, node long"), 3, limit)).collect()}
        assert [to.get(i, i) for _, i in rows] == want


def test_gray_order_has_one_bit_between_neighbours():
    ranks = np.arange(64, dtype=np.uint64)
    codes = ranks ^ (ranks >> np.uint64(1))
    assert (simhash.gray_rank(codes) == ranks).all()


def plain_copies(texts, similarity=0.8):
    """The first of each text's class: Jaccard of five-word shingles, by comparing all."""
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def family(n, seed=21, most=4):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(2000)]
    base = [r.choice(words) for _ in range(300)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in r.sample(range(300), r.randint(0, most)):
            copy[k] = r.choice(words)
        out.append(" ".join(copy))
    return out + [" ".join(r.choice(words) for _ in range(r.randint(1, 300))) for _ in range(n // 2)]


def test_links_in_a_class_are_those_of_all_pairs(spark, given, docs):
    texts = [t for _, t in pairs(given)] + [t for _, t in pairs(docs)] + family(60) + family(40, 5, 12)
    sets = [(i, 1, bytearray(simhash.shingles_of((t or "").encode()))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(sets, "node long, class long, shingles binary")
    to = {x["node"]: x["component"] for x in simhash.components(simhash.alike_links(df, 0.8)).collect()}
    assert [to.get(i, i) for i in range(len(texts))] == plain_copies(texts)


def test_near_copies_are_found_and_no_others(spark, given, docs):
    texts = [t for _, t in pairs(given)] + [t for _, t in pairs(docs)] + [t for k in range(40) for t in family(8, k, 8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    of = {x["doc_id"]: x["copy_of"] for x in simhash.near_copies(df).collect()}
    want = plain_copies(texts)
    found, whole = defaultdict(set), defaultdict(set)
    for i, k in enumerate(want):
        found[of[i]].add(i)
        whole[k].add(i)
    assert all(len({want[i] for i in g}) == 1 for g in found.values())  # nothing is linked that is not alike
    both = [(i, j) for g in whole.values() for i in g for j in g if i < j and texts[i] != texts[j]]
    assert len(both) > 500 and np.mean([of[i] == of[j] for i, j in both]) >= 0.95


def test_a_large_family_of_unlike_copies_meets_in_few_pairs(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(600):  # between them all similarities from 0.4 to 0.9
        copy = list(base)
        for k in r.sample(range(150), r.randint(1, 9)):
            copy[k] = f"e{r.randrange(10**9)}"
        texts.append(" ".join(copy))
    sets = [(i, 1, bytearray(simhash.shingles_of(t.encode()))) for i, t in enumerate(texts)]
    compared, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    df = spark.createDataFrame(sets, "node long, class long, shingles binary")
    to = {x["node"]: x["component"] for x in simhash.components(simhash.alike_links(df, 0.8)).collect()}
    assert [to.get(i, i) for i in range(len(texts))] == plain_copies(texts)
    assert sum(compared) < 40 * len(texts)  # of 300 for each text


def test_fingerprints_of_rows_without_ids_are_nodes_of_their_own(spark):
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    x, y, z = say(400), say(90), say(90)
    near = [*x[:200], "changed", *x[201:]]
    rows = [(3, x), (None, near), (None, y), (7, near), (7, z), (None, z), (None, say(50)), (9, say(50)), (9, x)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    prints = [(d, plain_fingerprint(t)) for d, t in pairs(df)]
    want = Counter((d, f, c) for (d, f), c in zip(prints, plain_components(prints), strict=True))
    assert Counter((g["doc_id"], g["fp"] & (2**64 - 1), g["component_id"]) for g in simhash.near_duplicates(df).collect()) == want
    assert (None, plain_fingerprint(" ".join(y)), None) in want and (None, plain_fingerprint(" ".join(z)), 7) in want


def test_keep_one(docs, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    first = {}
    rows = sorted(set(pairs(docs)), key=lambda x: (x[0] is None, x[0] or 0, signed_hash(x[1])))
    for (d, t), k in zip(rows, plain_copies([t for _, t in rows]), strict=True):
        first.setdefault(k, (d, t))
    assert Counter(pairs(kept)) == Counter(first.values())
    assert [r for r in kept.collect() if any(r[c] != f"own {c}" for c in CLASH)] == []
    assert simhash.keep_one(nothing).count() == 0


# --- 3

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x[:9] if len(x.lstrip("0")) > 3 else x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "given"])
def test_private_base_spans(which, request):
    df = request.getfixturevalue(which)
    want = Counter()
    for d, t in pairs(df):
        s = plain_spans(t)
        n = Counter(x[3] for x in s)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want[(d, *(n[k] for k in PLAIN), hashlib.sha256(listed.encode()).hexdigest())] += 1
    got = private.private_spans(df).collect()
    assert Counter(tuple(r[:6]) for r in got) == want


def test_terms_that_disclose(spark, nothing):
    r = random.Random(5)
    fill = lambda: " ".join("".join(r.choice("aeioubdg") for _ in range(5)) for _ in range(12))
    texts = [f"{fill()} xylophone a@b.org common {fill()}" for _ in range(5)] + [f"{fill()} common {fill()}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x["doc_id"]: x["spans"] for x in private.private_spans(df).collect()}
    for i in range(5):
        a, m = texts[i].index("xylophone"), texts[i].index("a@b")
        assert rows[i] == f"term_removed:{a}:{a + 9},email:{m}:{m + 7}"
    assert all(rows[i] == "" for i in range(5, 65))
    clean = {x["doc_id"]: x["text"] for x in private.sanitised(df).collect()}
    assert clean[0] == texts[0].replace("xylophone", "[TERM REMOVED]").replace("a@b.org", "[EMAIL]")
    assert clean[9] == texts[9]
    assert private.private_spans(nothing).count() == 0 and private.sanitised(nothing).columns == nothing.columns


def plain_terms(texts, alpha=private.ALPHA, prior=private.PRIOR):
    """(document, term, removed) of the terms that give an entity away, from all pairs."""
    words = lambda t: {w.lower() for w in regex.findall(r"\p{L}{3,}", t)}
    entities, near, all_ = defaultdict(set), {}, Counter()
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        all_.update(words(t))
        for a, _, b, k in spans:
            entities[f"{k}:{t[a:b].lower()}"].add(i)
        gone = {x for a, _, b, _ in spans for x in range(a, b)}
        near[i] = words("".join(" " if x in gone else c for x, c in enumerate(t)))
    out = {}
    for held in entities.values():
        p = len(held) / len(texts)
        for term in set().union(*(near[i] for i in held)):
            both = {i for i in held if term in near[i]}
            pmi = math.log2((len(both) + prior * p) / (all_[term] + prior) / p)
            if pmi >= -math.log2(p) / alpha - 1e-12:
                for i in both:
                    out[i, term] = out.get((i, term), False) or len(both) >= all_[term]
    return {(*k, v) for k, v in out.items()}


def test_terms_are_those_of_their_pmi(spark):
    r = random.Random(15)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 5))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 14))) + r.choice(["", "", f" u{r.randint(0, 9)}@x.org", " 10.0.0.1 secretly", " b@c.de +49 30 1234567"]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = set()
    for x in private.private_spans(df).collect():
        for kind, a, b in (y.split(":") for y in x["spans"].split(",") if y.startswith("term")):
            got.add((x["doc_id"], texts[x["doc_id"]][int(a) : int(b)].lower(), kind == "term_removed"))
    assert got == plain_terms(texts) and got


def test_pages_of_many_values_and_copies_of_them_give_few_pairs(spark, monkeypatch):
    page = " ".join(f"{a}{b}{c}@mail.org term{a}{b}{c}" for a in "abcdefg" for b in "abcdefg" for c in "abcdefgh")
    sizes, keep = {}, private.kept
    monkeypatch.setattr(private, "kept", lambda df, name: (lambda t: sizes.__setitem__(name, t.count()) or t)(keep(df, name)))
    for copies in (1, 2, 5):
        df = spark.createDataFrame([(i, page if i < copies else f"plain words number {i}") for i in range(3000)], "doc_id long, text string")
        rows = {r["doc_id"]: r["n_email"] for r in private.private_spans(df).collect()}
        assert [rows[i] for i in range(copies)] == [392] * copies and sizes["pairs"] <= 400 * copies


def test_a_text_of_many_matches_is_read_in_time(spark):
    text = "é " + " ".join(f"a{i}@b.org or 10.0.0.{i % 256}, word" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "x@y.org")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["spans"]) for r in private.private_spans(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in private.sanitised(df).collect()}
    assert time.time() - began < 60  # 80,000 matches; the fold with appends took over ten seconds for 8,000
    assert got[1][:2] == (40_000, 40_000) and clean[2] == "[EMAIL]"
    assert clean[1] == "é " + " ".join("[EMAIL] or [IP], word" for _ in range(40_000))
    spans = [x.split(":") for x in got[1][2].split(",")]
    assert all(text[int(i) : int(j)] == (f"a{n // 2}@b.org" if n % 2 == 0 else f"10.0.0.{n // 2 % 256}") for n, (_, i, j) in enumerate(spans))


def test_sanitised_keeps_rows_and_columns(docs):
    out = private.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r for r in out.collect() if any(r[c] != f"own {c}" for c in CLASH)] == []
    assert not [x for x in out.collect() if "@b.co" in (x["text"] or "")]


# --- 4


def test_leaks_exact_edited_and_clean(spark, nothing):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(3000)] + ["the", "of"] * 300
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [say(35) for _ in range(20)]
    docs, want = [], set()
    for i in range(200):
        d = say(120)
        if i % 4 == 0:
            k = i // 4 % 20 if i % 8 else 3  # item 3 is very common
            copy = list(items[k])
            for j in range(2, 35, 6):
                copy[j] = "edited"
            d[40:40] = copy
            want.add((i, k))
        docs.append((i, " ".join(d)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "the of"), (None, "x y z")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert all(38 <= x["first_word"] <= 42 and 73 <= x["end_word"] <= 77 for x in got)
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.without_leaks(df, bench).count() == df.count() - len(want)
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == df.count()


def test_long_items_are_scored_whole(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = {1: [*say(400), "in", "the", "end"], 2: say(1000), 3: say(5000)}
    docs = {1: [*say(3), "in", "the", "end", *say(3)], 2: [*say(50), *items[2][300:520], *say(50)], 3: [*say(9), *items[2][100:800], *say(9)], 4: [*say(30), *items[1], *say(9)], 5: items[3][:4000]}
    rows = [(d, " ".join(w)) for d, w in docs.items()]
    rows += [(None, rows[3][1]), (None, "clean words only " * 9), (4, "other clean words " * 9), rows[3], (8, "x " * 30_000), (9, "y" * 300_000 + " " + rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["score"], x["end_word"] - x["first_word"]) for x in decontaminate.leaks(df, bench).collect()}
    assert got == {(3, 2): (0.7, 700), (4, 1): (1.0, 403), (None, 1): (1.0, 403), (5, 3): (0.8, 4000), (9, 1): (1.0, 403)}
    left = Counter((x["doc_id"], x["text"][:20]) for x in decontaminate.without_leaks(df, bench).collect())
    assert left == Counter((d, t[:20]) for d, t in rows if (d, t) not in [rows[2], rows[3], rows[4], rows[5], rows[10]])


def test_rarity_comes_before_passages(spark, given):
    """10,000 items of common prose: of all words, an item is aligned to less than 1 in 2,000."""
    r = random.Random(10)
    prose = [t.split() for t in (x["text"] for x in given.where("length(text) > 400").select("text").collect())]
    words = [x for w in prose for x in w]
    items = [[r.choice(words) for _ in range(30)] for _ in range(9_000)] + [w[k : k + 5] + [r.choice(words) for _ in range(25)] for w in prose for k in range(0, len(w) - 12, 60)][:1_000]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    texts = decontaminate.keyed_documents_of(given)
    table = decontaminate.kept(decontaminate.item_table(bench), "items")
    grams = table.selectExpr("explode(grams) as gram")
    seeds = decontaminate.seeds_of(table, decontaminate._frequencies(texts, decontaminate._bit_set(grams)), texts.count())
    found = decontaminate.passages(decontaminate._places(texts, decontaminate._bit_set(seeds)), seeds).selectExpr("sum(last - first) as n").first()["n"] or 0
    assert found < 0.0005 * len(items) * sum(map(len, prose))


@pytest.mark.parametrize("piece", [7, 1 << 17])
def test_word_hashes_are_those_of_words(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    r, of = random.Random(1), {}
    for _ in range(300):
        low = "".join(r.choice("ab_ ,\n\u00e9\u4e2d\u2014") for _ in range(r.randint(0, 60)))
        h, begin = decontaminate.word_hashes(low)
        words = list(re.finditer(r"\w+", low))
        assert begin.tolist() == [m.start() for m in words]
        assert all(of.setdefault(m[0], x) == x for m, x in zip(words, h.tolist(), strict=True))
    assert len(set(of.values())) == len(of)


def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_scores():
    r = np.random.default_rng(2)
    a = [r.integers(0, 5, r.integers(3, 20)) for _ in range(60)]
    b = [r.integers(0, 6, r.integers(3, 50)) for _ in range(60)]
    a, b = [x.astype(np.uint64) for x in a], [x.astype(np.uint64) for x in b]
    assert decontaminate.smith_waterman(a, b)[0].tolist() == [plain_smith_waterman(x, y) for x, y in zip(a, b, strict=True)]


# --- 5


@pytest.mark.parametrize("which", ["docs", "given"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(queries.vocabulary())
    want, lengths = Counter(), []
    for d, text in pairs(df):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            lengths.append(len(part))
            want[(d, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    got = packing.pack(df, queries.vocabulary(), partition=100).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(n for _, n in b) <= 2048
    assert len(bins) <= packing.lower_bound(np.array(lengths)) + 2


def test_lower_bounds_never_exceed_what_is_possible():
    r = np.random.default_rng(1)
    for _ in range(200):
        lengths = r.integers(1, r.integers(2, 101), r.integers(1, 40))
        made = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(made, weights=lengths).max() <= 100
        assert -(-lengths.sum() // 100) <= packing.lower_bound(lengths, 100) <= made.max() + 1
    # pieces of a known perfect packing: no bound may exceed its count
    for _ in range(100):
        cut = [np.diff(np.r_[0, np.sort(r.choice(np.arange(1, 100), r.integers(1, 5), replace=False)), 100]) for _ in range(20)]
        assert packing.lower_bound(np.concatenate(cut), 100) == 20


def test_encoder_equals_the_tokenizer_over_stretches_and_generations(monkeypatch):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh中文ΣбяéÉß'-.,0123") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    plain = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) + r.choice(["", ".", ",", "?!"]) for _ in range(3000)]
    encode = packing.Encoder(queries.vocabulary())
    want = lambda t: np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    long = " ".join(r.choice(words) for _ in range(20_000))
    assert len(long) > packing.STRETCH and packing._OTHER.search(long) and encode(long) == want(long)
    monkeypatch.setattr(packing, "STRETCH", 300)
    monkeypatch.setattr(packing, "CACHE", 50)
    for _ in range(150):
        text = " ".join(r.choice(r.choice([words, plain])) for _ in range(r.randint(0, 400)))
        assert encode(text) == want(text)
        text = " ".join(r.choice(plain) for _ in range(60))
        assert encode(text) == want(text) and len(encode.runs) < 400


def test_packing_tells_its_count_and_bound(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 3000)) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary(), partition=60).collect()
    n, bound = {(x["n_sequences"], x["lower_bound"]) for x in out}.pop()
    assert n == len({x["sequence_id"] for x in out}) and bound == packing.lower_bound(np.array([x["length"] for x in out])) and bound <= n <= bound * 1.1 + 1


def test_packing_nothing(nothing):
    assert packing.pack(nothing, queries.vocabulary()).count() == 0


# --- 6


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)  # Spark's xxhash64
    return h - (1 << 64) if h >> 63 else h


def plain_repeats(rows, n=100):
    first, out = {}, {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is None, x[0] or 0, signed_hash(x[1]))):
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - n + 1):
            if first.setdefault(raw[i : i + n], (d, i)) != (d, i):
                gone[i : i + n] = True
        left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        out[d, t] = (d, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return Counter(out[d, t or ""] for d, t in rows)


@pytest.mark.parametrize("which", ["docs", "given"])
def test_repeated_substrings(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    assert Counter(tuple(r[:5]) for r in substrings.without_repeats(df).collect()) == plain_repeats(pairs(df))


def test_repeats_stay_in_rows_of_one_doc_id(spark):
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = say(150)
    rows = [(1, passage + say(90)), (5, passage + say(120)), (5, say(300)), (5, None), (None, passage + say(40)), (None, say(200)), (None, passage + say(77)), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x[:5]) for x in substrings.without_repeats(df).collect()) == plain_repeats(rows)


@pytest.mark.parametrize("limit", [substrings.LIMIT, 3, 1])
def test_repeats_across_pieces_and_batches(spark, limit):
    r = random.Random(4)
    shared = "".join(r.choice("ab ") for _ in range(700))
    rows = [(i, "".join(r.choice("abc ") for _ in range(r.randint(0, 300))) + shared[r.randint(0, 500) :] + "".join(r.choice("abc ") for _ in range(200))) for i in range(60)]
    rows += [(60, "z" * 3000), (61, "zy" * 800), (62, "z" * 150)]
    rows += rows[:9]  # rows that are there twice
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert Counter(tuple(x[:5]) for x in substrings.without_repeats(df, limit=limit).collect()) == plain_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_that_repeat_cost_no_more_than_one(spark, monkeypatch):
    passage, tail = " ".join(f"p{i * 7919}" for i in range(700)), " ".join(f"t{i * 104729}" for i in range(300))
    rows = [(1, passage)] + [(5, passage + " " + tail)] * 10_000
    sizes, keep = {}, substrings.kept
    monkeypatch.setattr(substrings, "kept", lambda df, name: (lambda t: sizes.__setitem__(name, t.count()) or t)(keep(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter(tuple(r) for r in substrings.without_repeats(df).drop("kept").collect())
    n, left = len(passage), (" " + tail).encode()
    want = (5, n + len(left), n, 1, hashlib.sha256(left).hexdigest())
    assert got[want] == 10_000 and got[(1, n, 0, 0, hashlib.sha256(passage.encode()).hexdigest())] == 1
    assert sizes["anchors"] < 1000 and sizes["ends"] < 1000


def test_runs_of_a_common_bucket_do_not_become_windows(spark, monkeypatch):
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    line, long_ = say(70), say(130)
    rows = [(i, say(120) + (line if i % 2 else long_) + say(120)) for i in range(2000)]
    sizes, keep = {}, substrings.kept
    monkeypatch.setattr(substrings, "kept", lambda df, name: (lambda t: sizes.__setitem__(name, sizes.get(name, 0) + t.count()) or t)(keep(df, name)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter(tuple(x[:5]) for x in substrings.without_repeats(df, limit=256).collect()) == plain_repeats(rows)
    assert sum(n for name, n in sizes.items() if name != "anchors") < 30 * len(rows), sizes


def test_pieces_of_long_texts_overlap():
    data = np.frombuffer(b"".join(bytes([97 + i % 23, 97 + i * 7 % 19]) for i in range(3000)), dtype=np.uint8)
    whole = substrings.anchors(data, np.array([len(data)]))
    assert ((whole[5] >= whole[3]) & (whole[5] + substrings.GRAM <= whole[3] + substrings.LENGTH)).all()
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[3], whole[4], strict=True)])
    assert (covered == np.arange(len(data) - substrings.LENGTH + 1)).all()


# --- 7


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(repeated)


@pytest.mark.parametrize("which", ["docs", "given"])
def test_rule_counts(which, request):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r[:6]) for r in rules.rule_stats(df).collect())
    assert got == Counter((d, *plain_counts(t)) for d, t in pairs(df))


def test_rules_verdict(given, spark, sf, nothing):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = {r["doc_id"]: r for r in rules.quality_rules(given, labels).collect()}
    for r in rows.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    good = [rows[d]["kept"] for d, q in marks.items() if q == 1 and not rows[d]["base_failed"]]
    bad = [rows[d]["kept"] for d, q in marks.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2
    assert rules.quality_rules(nothing, labels).count() == 0
    assert rules.quality_rules(given, labels.limit(0)).where("kept = base_failed").count() == 0


def test_rules_judge_rows_not_ids(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = random.Random(2)
    good = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(120))
    rows = [(None, good), (None, "too short"), (7, good), (7, "short"), (7, None)]
    left = rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0)).collect()
    assert Counter(map(tuple, left)) == Counter([rows[0], rows[2]])
    out = rules.keep_good(docs, labels.limit(0))
    assert out.columns == docs.columns and out.count() == sum(plain_counts(t)[0] >= 50 and 2 * plain_counts(t)[4] <= plain_counts(t)[0] for _, t in pairs(docs))
    assert [x for x in out.collect() if any(x[c] != f"own {c}" for c in CLASH)] == []


def test_labelled_rows_at_the_driver_are_bounded(spark):
    texts = [(1, f"word {i % 9} " * 60) for i in range(5000)] + [(i, f"other text {i} " * (50 + i)) for i in range(2, 20)] + [(1, f"{'x ' * k}") for k in range(60, 90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    counts, quality = rules.labelled_counts(docs, labels)
    assert len(counts) == len(quality) == 18 + rules.TEXTS
    assert pu.classify(docs, labels).count() == len(texts)


def test_rules_learn_from_every_labelled_text(spark):
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abcdefghijklm") for _ in range(k))
    usual = [(i, " ".join(word(r.randint(3, 8)) for _ in range(r.randint(60, 90)))) for i in range(2, 150)]
    other = [(1, usual[k][1]) for k in range(4)] + [(1, "\n".join(f"{word(14).upper()} | #{r.randint(0, 10**9)}" for _ in range(100 + k))) for k in range(300)]  # of one doc_id, good as well
    docs = spark.createDataFrame(usual + other, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 150)], "doc_id long, quality int")
    out = rules.quality_rules(docs, labels).collect()
    assert not any(x["base_failed"] for x in out) and sum(not x["kept"] for x in out) <= 0.01 * len(out)
    assert rules.keep_good(docs, labels).count() == sum(x["kept"] for x in out)


def test_forest_scores_are_mean_paths():
    r = np.random.default_rng(3)
    good, bad = r.normal(size=(300, 4)), r.normal(3, 1, size=(40, 4))
    f = rules.fit_forest(good, bad)
    usual = lambda n: 2 * (sum(1 / i for i in range(1, n)) - (n - 1) / n) if n > 1 else 0
    for x, got in zip(np.r_[good[:5], bad[:5]], f.scores(np.r_[good[:5], bad[:5]]), strict=True):
        paths = []
        for feature, split, path in zip(f.feature, f.split, f.path, strict=True):
            at = depth = 0
            while feature[at] >= 0:
                at, depth = 2 * at + (2 if x[feature[at]] >= split[at] else 1), depth + 1
            paths.append(path[at])
            assert path[at] >= depth
        assert abs(got - 2 ** (-np.mean(paths) / rules._usual_path(f.sample))) < 1e-9
    assert abs(rules._usual_path(256) - usual(256)) < 0.01
    kept_good, kept_bad = (np.mean(f.scores(v) <= f.threshold) for v in (good, bad))
    assert kept_good >= 0.985 and kept_bad < 0.3  # max_loss is one in a hundred


# --- 8


@pytest.mark.parametrize("which", ["docs", "given", "nothing"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got = sharding.shard(df).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs(df))
    assert Counter(tuple(r[:3]) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if which == "given":
        assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in got)


@pytest.mark.parametrize(("bits", "dims"), [(2, 2), (3, 2), (2, 3)])
def test_hilbert_steps_to_neighbours(bits, dims):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    order = np.argsort(sharding.hilbert_index(points, bits))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


# --- 9 and 10


def held_out(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 3 == 1


def test_language(given, docs, nothing):
    rows = language.identify(given).collect()
    true = {r["doc_id"]: r["lang"] for r in given.select("doc_id", "lang").collect()}
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in rows)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97
    odd = language.identify(docs).collect()
    by = {r["doc_id"]: r for r in odd}
    assert len(odd) == docs.count() and by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in odd)
    assert language.identify(nothing).count() == 0


def test_language_counts_and_scores_are_plain_naive_bayes(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("abc abd", "x"), ("abab", "x"), ("zzyz zy", "y"), ("yz", "y")] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, weights, prior = language.train(df)
    counts = {g: np.full(language.BUCKETS, 0.5) for g in "xy"}
    for i, t, g in rows:
        if not held_out(i):
            for h in language.ngrams(t):
                np.add.at(counts[g], h, 1)
    for k, g in enumerate(langs):
        assert np.allclose(weights[:, k], np.log(counts[g] / counts[g].sum()), atol=1e-5)


def test_language_predictions_are_plain_bayes(spark):
    r = random.Random(12)
    say = lambda abc: "".join(r.choice(abc) for _ in range(r.randint(1, 40)))
    rows = [(i, say("abcde " if i % 2 else "cdefg "), "xy"[i % 2]) for i in range(120)] + [(200, "\u00bd \u00b2 \u2167 5", "x"), (201, None, "y"), (202, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, seen = {g: Counter() for g in "xy"}, Counter()
    grams = lambda t: [int(h) for part in language.ngrams(t) for h in part]
    for i, t, g in rows:
        if not held_out(i):
            seen[g] += 1
            counts[g].update(grams(t) if t is not None else [])
    weight = {g: math.log(seen[g] / sum(seen.values())) for g in "xy"}
    total = {g: sum(counts[g].values()) + 0.5 * language.BUCKETS for g in "xy"}
    for x in language.identify(df).collect():
        t = rows[x["doc_id"] if x["doc_id"] < 120 else x["doc_id"] - 80][1]
        if not t or not regex.search(r"\p{L}", t):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        s = {g: weight[g] + sum(math.log((counts[g][h] + 0.5) / total[g]) for h in grams(t)) for g in "xy"}
        best = max("xy", key=lambda g: s[g])
        assert x["lang_pred"] == best and abs(x["score"] - 1 / sum(math.exp(v - s[best]) for v in s.values())) < 1e-3


def test_many_languages_share_fewer_buckets(spark):
    df = spark.createDataFrame([(i, f"text {i % 700} of its own", f"l{i % 700}") for i in range(2100)], "doc_id long, text string, lang string")
    langs, weights, _ = language.train(df)
    assert len(langs) > 512 and weights.size <= language.CELLS


def test_positive_unlabelled_risk_and_gradient():
    r = np.random.default_rng(4)
    p, u, w, prior = r.normal(size=(30, pu.INPUTS)), r.normal(size=(50, pu.INPUTS)), r.normal(size=pu.INPUTS) / 9, 0.3
    sigmoid = lambda z: 1 / (1 + np.exp(z))
    both = lambda w: (prior * sigmoid(p @ w).mean(), sigmoid(-(u @ w)).mean() - prior * sigmoid(-(p @ w)).mean())
    for prior in (0.3, 0.95):
        got = pu.risk(pu.slope(p, w, 1) / len(p), pu.slope(p, w, -1) / len(p), pu.slope(u, w, -1) / len(u), prior)
        good, rest = both(w)
        assert abs(got[0] - (good + max(0, rest))) < 1e-9
        for k in (0, 7, pu.INPUTS - 1):
            step = np.eye(pu.INPUTS)[k] * 1e-6
            a, b = both(w + step), both(w - step)
            want = sum(a) - sum(b) if rest >= 0 else b[1] - a[1]  # where the second term is negative its gradient is reversed
            assert abs(got[1 + k] - want / 2e-6) < 1e-5


def test_class_prior_needs_no_negatives():
    r = np.random.default_rng(5)
    for prior in (0.2, 0.5, 0.85):
        p, u = r.beta(8, 2, 4000), np.r_[r.beta(8, 2, int(9000 * prior)), r.beta(2, 8, 9000 - int(9000 * prior))]
        bins = lambda v: np.bincount((v * 1000).astype(int), minlength=1000).astype(float)
        assert abs(pu.best_bin(bins(p), bins(u)) - prior) < 0.06
    assert pu.best_bin(bins(p), bins(p)) > 0.95


def test_positive_unlabelled(given, docs, nothing, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = pu.classify(given, labels).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    tested = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in tested]) > 0.85
    odd = pu.classify(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert pu.classify(nothing, labels).count() == 0 and {r["predicted"] for r in pu.classify(given.limit(5), labels.limit(0)).collect()} == {0}


# --- 1


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there.\n\nSecond  paragraph\nover two lines.", "x"),
        (1, 1, "b", "> hello   THERE.\nI agree.", "x"),
        (1, 2, "c", ">> hello there.\n> I agree.\nMe too.\n> second paragraph\n> over two lines.", "x"),
        (1, 3, "d", "> > deeper only\nnothing linked", "x"),
        (1, 4, "e", "> me too.\nyes", "x"),
        (2, 0, "a", "> hello there.\nother conversation", "x"),
        (2, 1, "a", None, "x"),
        (2, 2, "a", "", "x"),
        (None, 0, "a", "> hello there.", "x"),
        (2, None, "a", "> hello there.", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, own string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"], r["n_quotes"], r["own_text"]) for r in quotes.linked_messages(df).collect()}
    assert got == {
        (1, 0): (None, 0, 0, 0, "Hello there.\n\nSecond  paragraph\nover two lines."),
        (1, 1): (0, 0, 1, 1, "I agree."),
        (1, 2): (1, 0, 2, 2, "Me too."),
        (1, 3): (None, 3, 0, 0, "nothing linked"),
        (1, 4): (2, 0, 3, 1, "yes"),
        (2, 0): (None, 0, 0, 0, "other conversation"),
        (2, 1): (None, 1, 0, 0, ""),
        (2, 2): (None, 2, 0, 0, ""),
        (None, 0): (None, 0, 0, 0, ""),
        (2, None): (None, None, 0, 0, ""),
    }
    assert quotes.linked_messages(df.limit(0)).count() == 0


def plain_links(rows):
    """Of rows (conv, turn, role, text), all with conv and turn: what linked_messages gives, by comparing everything."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")
    found = {}
    for c, t, _, text in rows:
        runs, own, before = [], [], None
        for line in re.split("\r?\n", text or ""):
            m = re.match(r"(?:[ \t]*>)+", line)
            level, said = (m[0].count(">"), re.sub(r"^[ \t]", "", line[m.end() :])) if m else (0, line)
            if level == 0:
                own.append(said)
            if not norm(said):
                before = None
                continue
            if level == before:
                runs[-1][1] += " " + said
            else:
                runs.append([level, said])
            before = level
        found.setdefault((c, t), []).append(({(x, norm(y)) for x, y in [*runs, [0, "\n".join(own)]] if norm(y)}, "\n".join(own).strip("\n")))
    wrote = {}
    for at in sorted(found):
        for p, _ in found[at]:
            for level, x in p:
                if level == 0:
                    wrote.setdefault(x, []).append(at)
    links = {}
    for (c, t), same in found.items():
        for level, x in set().union(*(p for p, _ in same)):
            mine = [a for a in wrote.get(x, []) if a[0] == c][:1]
            if level and mine and mine[0] < (c, t):
                links.setdefault((c, t), []).append((level, False, -c, -mine[0][1]))
            elif level and len(x.split(" ")) >= quotes.ELSEWHERE and x in wrote and wrote[x][0][0] < c:
                links.setdefault((c, t), []).append((level, True, -wrote[x][0][0], -wrote[x][0][1]))
    out = Counter()
    for at, same in found.items():
        up, depth = at, 0
        while up in links:
            up, depth = tuple(-v for v in min(links[up])[2:]), depth + 1
        n = [x[0] for x in links.get(at, [])]
        reply = tuple(-v for v in min(links[at])[2:]) if n else (None, None)
        for _, own in same:
            out[(*at, *reply, *up, depth, n.count(1), len(n) - n.count(1), own)] += 1
    return out


def test_quotes_across_conversations_and_levels(spark):
    long = "this is a passage of more than eight words all told"
    rows = [(1, 0, "a", long), (1, 1, "b", f"> {long}\nshort"), (2, 0, "c", f"> {long}\n\nnew words here that are many enough to be found again"), (2, 1, "d", f">> {long}\n> {long} changed\nso it goes")]
    rows += [(3, 5, "e", "> new words here that are many enough to be found again\n>> " + long), (3, 6, "e", "> short\n> > so it goes\nx"), (0, 9, "f", f"> {long}"), (2, 1, "z", "a second row of this turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = Counter(tuple(x[:2]) + tuple(x[3:]) for x in quotes.linked_messages(df).collect())
    assert got == plain_links(rows)
    by = {x[:2]: x[2:8] for x in got}
    assert by[1, 1] == (1, 0, 1, 0, 1, 1) and by[2, 0] == (1, 0, 1, 0, 1, 1) and by[3, 5] == (2, 0, 1, 0, 2, 1) and by[0, 9] == (None, None, 0, 9, 0, 0)
    assert (2, 1, 1, 0, 1, 0, 1, 0, 1, "so it goes") in got  # a passage of level 2 leads to who wrote it


def test_every_row_of_the_conversations_stays(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "y"), (None, 2, "b", "z"), (3, None, None, None), (1, 2, "a", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert quotes.linked_messages(quotes.as_mail(df)).count() == len(rows)


def test_quotes_of_the_given_mail(spark, sf):
    mail = quotes.as_mail(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = [tuple(r) for r in mail.select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(x[:2]) + tuple(x[3:]) for x in quotes.linked_messages(mail).collect()) == plain_links(rows)


def test_quotes_of_mail_lead_back_to_their_messages(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    said = {(r["conv_id"], r["turn"]): r["text"] for r in c.collect()}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip()
    for r in quotes.linked_messages(quotes.as_mail(c)).collect():
        own, two = said[r["conv_id"], r["turn"]], said.get((r["conv_id"], r["turn"] - 2))
        assert r["own_text"] == own.strip("\n")
        if two is None or not norm(two):
            assert r["reply_to"] is None
        else:
            assert norm(said[r["conv_id"], r["reply_to"]]).find(norm(two)) >= 0 or norm(two) == norm(said[r["conv_id"], r["reply_to"]])
