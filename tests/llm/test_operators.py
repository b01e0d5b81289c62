import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corvidex.llm import decontamination, jaccard_join, license_scan, packing, quality_rules, secret_scan, token_counts, toxicity, url_filters
from corvidex.llm._session import Scratch
from corvidex.llm._text import shingles, word_hashes
from corvidex.llm.line_dedup import LineDedupParams, dedup_lines, winnow
from tests.llm.cases import frame, same, texts, words

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def shingle_set(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# Text helpers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é\n.-漢", max_size=60), max_size=6))
def test_word_hashes_tell_words_apart(held):
    hashes, rows = word_hashes(held)
    flat = [(i, w) for i, t in enumerate(held) for w in WORD.findall(t.lower())]
    assert rows.tolist() == [i for i, _ in flat]
    assert len({*zip(hashes.tolist(), (w for _, w in flat), strict=True)}) == len({w for _, w in flat}) == len(set(hashes.tolist()))


def test_shingles_stay_inside_texts():
    held = ["a b c d e f", "a b", "", "a b c d e", "b a"]
    value, rows = shingles(*word_hashes(held))
    assert rows.tolist() == [0, 0, 1, 3, 4]
    assert value[0] == value[3] and value[2] != value[4]


# 1 URL filters


def test_url_parts_and_given_rules(spark):
    urls = [None, "", "no scheme/en/", "HTTP://WWW.Example.COM/en/70?x=1#y", "a://b://c/d", "http://h.net?x", "http://de.net/de/8", "http://example.net/de/81", "http://xcom/en/", "http://com/en/", "http://a.org/es/", "http://É.COM/en/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, labels).collect()}

    def plain(u):
        if u is None or "://" not in u:
            host, path = "", ""
        else:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in url_filters.RULES if (host == (d := r.split("/")[0]) or host.endswith("." + d)) and path.startswith(r[len(d) :])]
        rule = max(fits, key=len) if fits else None
        return host, path, rule, url_filters.RULES.get(rule, "allow")

    assert got == {i: plain(u) for i, u in enumerate(urls)}


def test_mined_rules_equal_counting(spark):
    rows, marks = [], []
    for i in range(200):
        spam = i % 4 == 0
        rows.append((i, f"http://{'win' if spam else 'site'}{'' if i % 8 else 'ner'}.biz/{'free/bets' if spam else 'news'}/{i}"))
        marks.append((i, 0 if spam and i % 20 else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks + [(0, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined_confidence) for r in url_filters.judge(pages, labels, params=url_filters.UrlFilterParams(min_pages=10, min_confidence=0.6)).collect()}
    bad = {i for i, q, _ in marks if q == 0}
    tokens = {i: {"host=" + x for x in u.split("/")[2].split(".")} | {"path=" + x for x in u.split("/")[3:]} for i, u in rows}
    best = {}
    for size in (1, 2, 3, 4):
        for combo in {c for t in tokens.values() for c in combinations(sorted(t), size)}:
            having = [i for i, t in tokens.items() if set(combo) <= t]
            hits = len(bad & set(having))
            if hits >= 10 and hits / len(having) >= 0.6:
                for i in having:
                    best[i] = max(best.get(i, 0), round(hits / len(having), 6))
    assert best and got == {i: ("block", best[i]) if i in best else ("allow", None) for i, _ in rows}


def test_labels_belong_to_the_document_in_the_path(spark):
    ends = ["", "/", ".html", "?page=7&ref=x", "#top"]
    rows = [(5000 - i, f"http://h.biz/{'bad' if i % 4 == 0 else 'good'}/{i}{ends[i % 5]}") for i in range(200)] + [(i, "http://h.biz/good/about7x") for i in range(0, 200, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {(r.page_id, r.verdict, r.mined_confidence) for r in url_filters.judge(pages, labels, {}).collect()}
    assert got == {(i, "block", 1.0) if "/bad/" in u else (i, "allow", None) for i, u in rows}


# 2 Toxicity


def test_toxicity_learns_and_takes_all_texts(spark):
    docs = [(i, words(i, 80) + (" you utter scoundrel" if i % 3 == 0 else " you kind soul") + " " + words(-i, 30)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, docs), labels, toxicity.ToxicityParams(hash_bits=16, features=4000))
    got = {r.doc_id: r for r in toxicity.score(frame(spark, docs), model).collect()}
    assert len(got) == 240 and all(got[i].predicted == (i % 3 == 0) == (got[i].score >= 0.3) for i, _ in docs)
    odd = toxicity.score(frame(spark), model, ("__s", "__p"))
    assert odd.count() == len(texts()) and "score" in odd.columns
    assert all(0 <= r["__s"] <= 1 for r in odd.collect())
    empty = toxicity.fit(frame(spark, []), labels)
    assert {r.predicted for r in toxicity.score(frame(spark), empty).collect()} == {0}


# 3 Line dedup


def runs_removed(rows, least=50):
    """By (id, text): (text left, lines removed), from all runs of ``least`` words or more, whatever their length."""
    parts = {k: [(n, x, len(x.split())) for n, x in enumerate(k[1].split("\n")) if x.split()] for k in dict.fromkeys(rows) if k[1] is not None}
    seen, out = {}, {}
    for k in sorted(parts, key=lambda k: (k[0] is not None, k[0] or 0)):
        gone, lines = set(), parts[k]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= least:
                    first, last = seen.setdefault(tuple(x for _, x, _ in lines[a : b + 1]), (k, lines[b][0]))
                    gone |= {n for n, _, _ in lines[a : b + 1] if first != k or n > last}
        out[k] = ("\n".join(x for n, x in enumerate(k[1].split("\n")) if n not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rows = texts()
    got = [(r.doc_id, r.text, r.n_removed_lines) for r in dedup_lines(frame(spark, rows)).collect()]
    left = runs_removed(rows)
    same(got, [(i, *left.get((i, t), (t, 0))) for i, t in rows])
    assert {i: n for i, _, n in got if n} == {2: 1, 10: 1}
    assert dedup_lines(frame(spark, [])).count() == 0
    kept = dedup_lines(frame(spark), counts=False)
    assert kept.columns == frame(spark).columns and {r.n_lines for r in kept.collect()} == {"mine"}


def test_winnowing_selects_window_minima(spark):
    rows = [(1, "\n".join(words(k, 1 + k % 30) for k in range(60)))]
    got = winnow(frame(spark, rows)).orderBy("line").collect()
    for i, r in enumerate(got):
        total, j = 0, i
        while j < len(got) and total < 50:
            total += got[j].words
            j += 1
        least = min(((x.h, -x.line) for x in got[i:j]), default=None) if total >= 50 else None
        assert (r.ahead and tuple(r.ahead)) == least
    assert len({r.ahead.at for r in got if r.ahead}) < len(got) / 2


def test_line_dedup_keeps_the_first_copy_inside_a_document(spark):
    block = "\n".join(words(k, 20) for k in range(3))
    text = "\n".join([block, words(50, 9), block, block])
    r = dedup_lines(frame(spark, [(1, text)])).first()
    assert r.text == "\n".join([block, words(50, 9)]) and r.n_removed_lines == 6
    same_line = "\n".join([words(1, 20)] * 7)
    assert dedup_lines(frame(spark, [(1, same_line)])).first().n_removed_lines == 4


def test_line_dedup_extends_past_the_last_window(spark):
    tail = "\n".join([words(1, 60), words(2, 10), words(3, 20)])
    rows = [(1, words(4, 5) + "\n" + tail + "\n" + words(5, 70)), (2, words(6, 5) + "\n" + tail + "\n" + words(7, 70)), (3, tail + "\n\n" + tail)]
    r = random.Random(3)
    pool = [words(100 + k, r.choice([1, 4, 10, 20, 30, 60])) for k in range(8)]
    rows += [(10 + k, "\n".join(r.choice([*pool, "", words(1000 + 50 * k + j, 7)]) for j in range(12))) for k in range(40)]
    got = {(x.doc_id, x.text, x.n_removed_lines) for x in dedup_lines(frame(spark, rows)).collect()}
    left = runs_removed(rows)
    assert got == {(i, *left[i, t]) for i, t in rows} and {i: n for i, _, n in got if i < 4} == {1: 0, 2: 3, 3: 6}


def test_line_dedup_takes_time_in_proportion_to_a_long_text(spark):
    text = "\n".join(f"line {k} of {k * 7}" for k in range(60_000))
    got = {r.doc_id: r for r in dedup_lines(frame(spark, [(1, text), (2, text)])).collect()}
    assert got[1].text == text and got[2].text == "" and got[2].n_removed_lines == 60_000


# 4 Decontamination


def test_decontamination_equals_brute_force(spark):
    items = [(k, words(100 + k, 12 + 9 * k) + "\n" + words(200 + k, 6 + k)) for k in range(20)] + [(50, "tiny item"), (51, None), (52, ""), (1, words(300, 30))]
    docs = texts() + [(100 + k, f"{words(k, 300)} {items[k][1].upper().replace(' ', ', ')} {words(k + 1, 40)}") for k in range(20)]
    docs += [(200 + k, f"{words(k, 20)} {items[k][1].splitlines()[0]}") for k in range(5)] + [(300, "see this tiny item here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    expected = set()
    for i, t in docs:
        for k, x in items:
            q, a = decontamination.split_item(x or "")
            qw, aw = (WORD.findall(y.lower()) for y in (q, a))
            w = qw + aw
            n = min(5, len(w))
            runs = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)] if n else []
            inside = max(len(qw) - n + 1, 0)
            d = WORD.findall((t or "").lower())
            held = {tuple(d[j : j + n]) for j in range(len(d) - n + 1)}
            share = lambda z: sum(y in held for y in z) / len(z) if z else 1.0
            if runs and share(runs[:inside]) >= 0.6 and share(runs[inside:]) >= 0.6:
                expected.add((i, k))
    assert got == expected and {(100 + k, k) for k in range(20)} | {(300, 50)} <= got
    assert not {(200 + k, k) for k in range(5)} & got
    small = decontamination.DecontaminationParams(block=3, smallest=4, max_postings=200)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, docs), bench, small).collect()} == expected
    kept = decontamination.decontaminate(frame(spark, docs), bench)
    assert kept.columns == frame(spark).columns and kept.count() == len(docs) - len([1 for i, _ in docs if i in {x for x, _ in expected}])
    assert decontamination.contaminated(frame(spark), bench.limit(0)).count() == 0


def bm25_shares(items, k1=1.2, b=0.75):
    """By item: {term: share of the item's BM25 impact}."""
    held = {k: Counter(WORD.findall((t or "").lower())) for k, t in items}
    held = {k: c for k, c in held.items() if c}
    df = Counter(t for c in held.values() for t in c)
    average = sum(sum(c.values()) for c in held.values()) / len(held)
    out = {}
    for k, c in held.items():
        n = sum(c.values())
        w = {t: np.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * n / average)) for t, f in c.items()}
        out[k] = {t: x / sum(w.values()) for t, x in w.items()}
    return out


def test_decontamination_goes_by_the_text_of_a_row(spark):
    item, clean, other = words(70, 60), words(71, 60), words(72, 60)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = [(1, item), (1, clean), (2, other), (None, item), (None, clean), (3, None), (2, other)]
    kept = decontamination.decontaminate(frame(spark, rows), bench).collect()
    same([(r.doc_id, r.text) for r in kept], [(1, clean), (2, other), (None, clean), (3, None), (2, other)])
    same([tuple(r)[:2] for r in decontamination.contaminated(frame(spark, rows), bench).collect()], [(1, 5), (None, 5)])


def test_scores_are_bm25_shares_and_reach_the_threshold(spark):
    vocabulary = words(910, 60).split()
    r = random.Random(6)
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 60)))) for k in range(150)]
    shares = bm25_shares(items)
    rows, postings = decontamination.weighed_items(spark.createDataFrame(items, "item_id long, text string"))
    rows = [x.asDict(recursive=True) for x in rows.collect()]
    assert postings == sum(map(len, shares.values()))
    for x in rows:
        assert sorted(y["weight"] for y in x["weights"]) == pytest.approx(sorted(shares[x["item_id"]].values()))
    params = decontamination.DecontaminationParams(threshold=0.5, block=3, smallest=8)
    by_class = defaultdict(set)
    for index in decontamination.build(rows, params):
        by_class[index.stretch] = set(index.ids)
        for seed in range(60):
            text = " ".join(random.Random(seed).choice(vocabulary) for _ in range(index.stretch))
            got = decontamination.retrieve(*word_hashes([text]), index, params)
            held = set(WORD.findall(text))
            expected = {k: sum(w for t, w in shares[k].items() if t in held) for k in index.ids}
            assert {index.ids[i]: pytest.approx(s) for _, i, s in got} == {k: s for k, s in expected.items() if s >= 0.5}
    assert sorted(k for ids in by_class.values() for k in ids) == list(range(150)) and len(by_class) > 2


def test_a_large_benchmark_takes_one_pass(spark):
    items = [(k, words(5_000 + k, 24)) for k in range(50_000)]
    docs = [(k, words(k, 200) + " " + items[k * 7][1] + " " + words(-k, 100)) for k in range(100)] + [(1000 + k, words(-1000 - k, 300)) for k in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contaminated(frame(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k * 7) for k in range(100)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


# 5 Packing


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path


def test_cuts_fill_their_slots(paths):
    params = packing.PackingParams("")
    for total in [*range(1, 600), 4095, 4096, 4097, 9000, 12345]:
        pieces = packing.cuts(total, params)
        assert sum(n for n, _ in pieces) == total and all(1 <= n <= 4096 // k for n, k in pieces)
        assert all(n >= 0.98 * (4096 // k) for n, k in pieces if k < params.classes)


def packed_right(got, rows, ids_of, capacity=4096):
    """Pieces tile their documents, hold their ids, and sequences are gapless; returns the pieces of each sequence."""
    ids = Counter(ids_of(x).tobytes() for _, x in rows)
    whole, by = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
        by[r.sequence_id].append(r)
    for i in {i for i, _ in rows}:
        expected = Counter()
        for j, x in rows:
            if j == i:
                e, held = ids_of(x), {(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in whole[i]}
                # Every id of the document once: from 0 on, piece by piece.
                at = 0
                while at < len(e):
                    n = max(n for s, n, c, t in held if s == at and t == len(e) and c == zlib.crc32(e[at : at + n].tobytes()))
                    expected[at, n, zlib.crc32(e[at : at + n].tobytes()), len(e)] += 1
                    at += n
        same_length = len({len(ids_of(x)) for j, x in rows if j == i}) == len([1 for j, _ in rows if j == i])
        if same_length:
            assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in whole[i]) == expected
    assert sum(r.length for r in got) == sum(len(ids_of(x)) for _, x in rows) and ids
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by


def test_packing_round_trip(spark, paths):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths("word_bpe_49k.json"))
    rows = [*texts(), (70, "It's <|startoftext|> don't\tİSTANBUL ΟΔΟΣ cafe\u0301  x\u00a0y"), (71, "A,b.C!D")]
    got = packing.pack(frame(spark, rows).repartition(3), packing.PackingParams(paths("word_bpe_49k.json"))).collect()
    packed_right(got, rows, lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4"))
    assert packing.padding(packing.pack(frame(spark, []), packing.PackingParams(paths("word_bpe_49k.json"))), 4096).first().n_sequences == 0


def test_bins_of_a_class_hold_its_count(spark, paths):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths("word_bpe_49k.json"))
    r = random.Random(9)
    rows = [(k, words(k, r.choice([1, 5, 40, 90, 150, 300, 700]))) for k in range(900)]
    params = packing.PackingParams(paths("word_bpe_49k.json"), capacity=1024, classes=8, fan_in=3)
    got = packing.pack(frame(spark, rows).repartition(11), params).collect()
    by = packed_right(got, rows, lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4"), 1024)
    of = lambda n: min(1024 // n, 8)
    workers = {s: held for s, held in by.items() if s >= 0}
    for held in workers.values():
        k = of(max(x.length for x in held))
        if k < 8:
            assert len(held) == k and {of(x.length) for x in held} == {k}
        else:
            assert sum(x.length for x in held) == 1024
    # A worker passes on at most k - 1 pieces of a class and one bin of the last.
    passed = Counter(of(x.length) for s, held in by.items() if s < 0 for x in held)
    assert all(n <= 11 * (k - 1) for k, n in passed.items() if k < 8) and sum(passed.values()) < len(got) / 2
    tokens = sum(x.length for x in got)
    assert len(by) * 1024 < 1.08 * tokens


# 6 Jaccard join


def test_jaccard_join_equals_brute_force(spark):
    rows = texts()
    base = words(400, 150).split()
    for k in range(40):
        copy = list(base)
        for j in range(k % 5):
            copy[(17 * k + 31 * j) % 150] = f"new{k}x{j}"
        rows.append((1000 + k, " ".join(copy)))
    got = {(r.doc_id, r.class_id, r.n_links, r.group_id) for r in jaccard_join.jaccard_join(frame(spark, rows), jaccard_join.JaccardParams(block=8)).collect() if r.doc_id is not None}
    classes = {}
    for i, t in rows:
        if i is not None:
            classes[t or ""] = min(i, classes.get(t or "", i))
    classes.pop("")
    sets = {c: shingle_set(t) for t, c in classes.items()}
    links, near = Counter(), defaultdict(set)
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            near[a].add(b)
            near[b].add(a)

    def group(c):
        seen, todo = {c}, [c]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return min(seen)

    named = {i: (i, classes[t], links[classes[t]], group(classes[t])) for i, t in rows if i is not None and t}
    assert {x for x in got if x[0] in named} == set(named.values()) and links[1000]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    ids = [None, *{x[3] for x in named.values()}, min(i for i, t in rows if i is not None and not t)]
    same([(r.doc_id,) for r in kept.collect()], [(i,) for i in ids])
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


def test_one_id_for_unrelated_texts_loses_none(spark):
    a, b, c, d = (words(k, 90) for k in (701, 702, 703, 704))
    near = " ".join([*c.split()[:-1], "other"])
    rows = [(1, a), (1, b), (2, c), (2, d), (3, near), (1, a), (4, b)]
    kept = jaccard_join.keep_one(frame(spark, rows))
    same([(r.doc_id, r.text) for r in kept.collect()], [(1, a), (1, b), (2, c), (2, d)])
    got = {(r.doc_id, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert got == {(1, 0), (2, 0), (2, 1), (3, 1), (4, 0)}


def test_rows_without_an_id_lead_only_where_none_has_one(spark):
    """Eight pairs of a text without an id and a near copy with one, and pairs without any: one row of each stays, that with the id."""
    pairs = [(words(900 + k, 90), " ".join([*words(900 + k, 90).split()[:-1], "other"])) for k in range(12)]
    rows = [x for k, (a, b) in enumerate(pairs) for x in ((None, a), (50 + k if k < 8 else None, b), (None, a))]
    kept = jaccard_join.keep_one(frame(spark, rows)).collect()
    assert len(kept) == 12 and {(r.doc_id, r.text) for r in kept if r.doc_id} == {(50 + k, pairs[k][1]) for k in range(8)}
    assert {r.group_id for r in jaccard_join.jaccard_join(frame(spark, rows[:24])).collect()} == set(range(50, 58))


def test_a_long_chain_costs_in_proportion(spark):
    stream = words(800, 3000).split()
    rows = [(k, " ".join(stream[4 * k : 4 * k + 90])) for k in range(700)]
    params = jaccard_join.JaccardParams(block=16)
    docs = jaccard_join._keyed(frame(spark, rows)).mapInArrow(jaccard_join._labels(params), "doc_id long, k1 long, k2 long, size long, nodes array<long>")
    entries = docs.selectExpr("doc_id AS c", "size", "explode(nodes) AS node")
    with Scratch(spark) as scratch:
        cells = jaccard_join._cells(entries.select("node", "c"), docs.selectExpr("doc_id AS c", "size"), scratch, params)
        assert cells.count() < 10 * len(rows)
    got = {r.doc_id: (r.n_links, r.group_id) for r in jaccard_join.jaccard_join(frame(spark, rows), params).collect()}
    # 86 shingles each; two neighbours a side share 78 or more of 94 at most.
    assert got == {k: (min(k, 2) + min(699 - k, 2), 0) for k in range(700)}


def test_prefixes_are_shortened_until_the_recall_is_reached():
    p = jaccard_join.JaccardParams()
    chance = lambda s, d: 1 - (1 - s**d) ** p.trees
    assert p.depth(1.0) == p.longest_prefix > p.prefix == p.depth(0.8) and chance(0.8, p.prefix) >= p.recall
    for s in (0.8, 0.83, 0.86, 0.9, 0.95):
        d = p.depth(s)
        assert chance(s, d) >= p.recall and (d == p.longest_prefix or chance(s, d + 1) < p.recall)


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 60)] + [(100 + k, 100) for k in range(1, 30)] + [(200, 201), (202, 201)]
    got = {(r.node, r.root) for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100 + k, 100) for k in range(30)} | {(k, 200) for k in (200, 201, 202)}


# 7 Quality rules


def test_quality_rules_equal_brute_force(spark):
    shared = "Subscribe  to our\tnewsletter " + words(600, 40)
    rows = [*texts(), *((2000 + k, words(k, 10) + "\n" + shared.upper() + "\n" + words(-k, 45 if k % 2 else 5)) for k in range(30))]
    params = quality_rules.QualityParams(min_documents=20, max_share=0.3)
    got = [tuple(r) for r in quality_rules.apply_rules(frame(spark, rows), "source", params).collect()]
    word = re.compile("[^\x20\x09-\x0d]+")
    norm = lambda x: re.sub("[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    docs = Counter(h for _, t in rows for h in {norm(x) for x in (t or "").split("\n") if word.search(x)})
    expected = []
    for i, t in rows:
        t = t or ""
        w, lines = word.findall(t), [x for x in t.split("\n") if word.search(x)]
        grams = defaultdict(list)
        for k in range(len(w) - 2):
            grams[tuple(w[k : k + 3])].append(k)
        again = {p + k for v in grams.values() if len(v) > 1 for p in v for k in range(3)}
        removed = sum(len(word.findall(x)) for x in lines if docs[norm(x)] > max(20, 0.3 * len(rows)))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        left = len(w) - removed
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), removed, failed, not failed and left >= 50 and left >= 0.5 * len(w)))
    same(got, expected)
    assert any(not x[7] and not x[8] for x in expected) and quality_rules.apply_rules(frame(spark, []), "source").count() == 0


def test_line_limit_is_a_share_of_the_host_at_any_size(spark):
    for n in (60, 600):
        # A line of a tenth of the documents goes, one of a two-hundredth stays.
        line = lambda k, n=n: (words(620, 60) + "\n" if k % 10 == 0 else "") + (words(621, 60) + "\n" if k % 200 == 1 else "")
        rows = [(k, line(k) + words(3000 + k, 70 if k % 20 else 20)) for k in range(n)]
        got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.apply_rules(frame(spark, rows), "source").collect()}
        assert got == {k: (60 if k % 10 == 0 else 0, k % 20 != 0) for k in range(n)}


# 8 Token counts


def test_token_counts_equal_the_library(spark, paths):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths("byte_bpe_50k.json"))
    odd = ["a   b", "x\n\n y \n z", " lead", "trail ", "it's we'll I'D", "<|endoftext|> mid<|endoftext|>", "tab\t\tx\u00a0 y\u3000z", "１２ 34ab", "\n", "  ", "a\u200bb \u0301c"]
    rows = [*texts(), *((500 + k, x) for k, x in enumerate(odd))]
    for head in (10, 10_000):
        got = [tuple(r) for r in token_counts.count_tokens(frame(spark, rows), token_counts.TokenCountParams(paths("byte_bpe_50k.json"), head=head, memo=50)).collect()]
        n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
        same(got, [(i, len((x or "").encode()), n(x), n(x) > 1024) for i, x in rows])
    assert token_counts.count_tokens(frame(spark, []), token_counts.TokenCountParams(paths("byte_bpe_50k.json"))).count() == 0


def test_a_frequent_long_pretoken_is_broadcast(spark, paths):
    params = token_counts.TokenCountParams(paths("byte_bpe_50k.json"), head=50)
    rows = [(k, f"word{'abcdefghij'[k % 10]} {'-' * 200} {words(k, 9)}") for k in range(90)]
    pieces = token_counts.piece_counts(token_counts.count_pretokens(frame(spark, rows), params), params)
    short, long = token_counts._head(pieces, params)
    assert long == {hashlib.md5((" " + "-" * 200).encode()).hexdigest(): len(token_counts._tokenizer(params.tokenizer).encode(" " + "-" * 200).ids)}
    assert all(len(x) <= 40 for x in short)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\t'.é<|>endoftx漢\u0301\u00a0\u2003", max_size=30))
def test_chunks_hold_the_same_pretokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    split, special = token_counts._splitter(path)
    spaced, plain, found = token_counts.chunks(text, special)
    total = found + sum(len(e) for x in [*(" " + c for c in spaced), *plain] for e in Tokenizer.encode_batch(token_counts._tokenizer(path), split.findall(x), add_special_tokens=False))
    assert total == len(token_counts._tokenizer(path).encode(text, add_special_tokens=False).ids)


# 9 Secret scans


def spans_by_regex(text):
    out = []
    for k, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if rule.ignore_case else 0):
            if len(m[2] if rule.kind == "assign" else m[0]) >= {"hex": 24}.get(rule.kind, rule.min_length):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


PARTS = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "ghp_", "x" * 36, "é", "漢", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "\n", "+/_.=-", "K"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_automaton_equals_regexes(text):
    assert secret_scan.spans(text, secret_scan.BASE_RULES + secret_scan.MORE_RULES) == spans_by_regex(text)


def test_secret_scan_takes_all_texts(spark):
    rows = [*texts(), (80, "é token = abcdef123 " + "f" * 30), (81, "0" * 200_000)]
    got = secret_scan.scan_secrets(frame(spark, rows)).collect()
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    same([(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in got], [(i, tuple((rules[k].kind, s, e) for s, e, k in spans_by_regex(t or ""))) for i, t in rows])
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


# 10 License scans


def test_license_scan_equals_containment(spark):
    rows = [*texts()]
    for k, (_, x) in enumerate(license_scan.TEMPLATES.items()):
        rows += [(3000 + k, f"{words(k, 33 + k)} {x.upper()} {words(-k, 70)}"), (3100 + k, x), (3200 + k, " ".join(x.split()[: len(x.split()) // 2]) + " " + words(k, 30))]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    held = {name: shingle_set(x) for name, x in license_scan.TEMPLATES.items()}
    expected = {(i, name) for i, t in rows for s in [shingle_set(t)] for name, x in held.items() if len(x & s) >= 0.8 * len(x)}
    assert got == expected and len(expected) >= 2 * len(held)
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_edited_copies_are_found_at_every_offset():
    classes = license_scan._classes(license_scan.TEMPLATES, license_scan.LicenseParams())
    for name in ("isc", "mit", "zlib", "gpl-3"):
        x = license_scan.TEMPLATES[name].split()
        edited = " ".join(x[: len(x) // 2] + words(77, 12).split() + x[len(x) // 2 :])
        assert len(shingle_set(edited) & shingle_set(license_scan.TEMPLATES[name])) >= 0.8 * len(shingle_set(license_scan.TEMPLATES[name]))
        for offset in range(0, 160, 3):
            text = f"{words(offset + 1, offset + 1)} {edited} {words(-offset - 1, 90)}"
            found = license_scan._matches(*shingles(*word_hashes([text])), classes, license_scan.LicenseParams())
            assert name in {n for _, n, _, _ in found}, (name, offset)


def test_minima_of_stretches_equal_direct_ones():
    r = np.random.default_rng(1)
    rows = np.repeat(np.arange(9), r.integers(1, 70, 9))
    value = r.integers(0, 2**60, len(rows), dtype=np.uint64)
    least = value
    for size, at, begins, follows in license_scan._stretches(rows, 4, 64):
        least = np.minimum.reduceat(least, begins)
        starts = [i for row in range(9) for i in range(np.searchsorted(rows, row), np.searchsorted(rows, row + 1), size)]
        ends = [min(i + size, int(np.searchsorted(rows, rows[i] + 1))) for i in starts]
        assert at.tolist() == starts and least.tolist() == [value[i:j].min() for i, j in zip(starts, ends, strict=True)]
        assert follows.tolist() == [k + 1 < len(starts) and rows[starts[k + 1]] == rows[i] for k, i in enumerate(starts)]
