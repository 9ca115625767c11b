"""Small brute-force checks of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from geoshroud.llm import chat, decontam, fingerprints, language_id, licenses, ngram_join, packing, suffix_dedup, toxicity, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, v long, c long"


def texts(seed=5, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(90))
    out = [None, "", " \n\t ", "one", "Two words", "!!! ???", "x" * 3000, "日本語のテキストです。" * 5, " ".join(r.choice(vocab) for _ in range(6000))]
    for _ in range(n):
        t = [r.choice(vocab) for _ in range(r.randint(0, 80))]
        if r.random() < 0.3:
            t[len(t) // 2 : len(t) // 2] = passage.split()[r.randint(0, 9) :]
        out.append(" ".join(t))
    for t in list(out[-60:]):
        w = t.split()
        if w:
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w) if r.random() < 0.7 else t)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    return rows, table(spark, rows).cache(), table(spark, [])


def test_fingerprints(docs, spark):
    rows, df, none = docs
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark, df).collect()}
    order = sorted(rows, reverse=True)
    by_text = {}
    for k, (i, t) in enumerate(order):
        x, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = x[: len(x) - len(x) // 2] + nxt[: len(x) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(x, r.fingerprint) == r.fingerprint
        if x == nxt:
            assert r.near_next == 1
    assert len(got) == len(rows) and fingerprints.fingerprints(spark, none).count() == 0
    lone = fingerprints.fingerprints(spark, table(spark, [(None, "a b c d e f g h")])).first()
    assert lone.near_next == 1


def contamination(rows, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for j in range(max(1, len(w) - width + 1) if w else 0):
            win[tuple(w[j : j + width])].add(i)
    out = {}
    for i, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, who = [0] * len(w), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if x := win.get(tuple(w[j : j + n])):
                    who |= x
                    hit[j : j + n] = [1] * n
        h = sum(hit)
        out[i] = (len(w), h, len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    return out


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_decontamination(docs, spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rows, df, none = docs
    items = [(0, None), (1, ""), (2, "TWO words"), (3, rows[20][1]), (4, rows[8][1][:300]), (4, rows[8][1][:300]), (10, rows[30][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(spark, df, bench).collect()
    got = {r[0]: tuple(r)[1:6] for r in found}
    want = contamination(rows, items, 13)
    assert got == want and any(x[4] for x in want.values())
    for r in found:  # offsets are those of the original text
        b = (rows[r.doc_id][1] or "").encode()
        assert sum(len(decontam.words_of(b[s.start : s.end])) for s in r.spans) == r.n_hit
        for s in r.spans:
            assert any(" ".join(x.decode() for x in decontam.words_of(b[s.start : s.end])[:2]) in " ".join(y.decode() for y in decontam.words_of((t or "").encode())) for _, t in items)
            assert (s.start == 0 or not decontam.words_of(b[s.start - 1 : s.start])) and not decontam.words_of(b[s.end : s.end + 1])
    named = df.withColumnsRenamed({"key": "_row", "v": "_k"})
    left = decontam.without_contaminated(spark, named, bench)
    assert left.columns == named.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, x in want.items() if not x[4])
    assert decontam.contamination(spark, none, bench).count() == 0 and not any(r.n_hit for r in decontam.contamination(spark, df, bench.limit(0)).collect())


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.net", "http://A.NET/x?q#f", "https://sub.example.net/en/1", "http://example.com/de/9", "http://x.org/fr/", "http://xorg/fr/", "ftp://news.example.com/en/5?x", "http://x.net:80/a", "http://thenews.example.org/en/a"] * 2
    pages = spark.createDataFrame([(i, u, "<title>the news the</title>", "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(spark, pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_filter.judge(spark, pages.limit(0)).count() == 0
    assert url_filter.viterbi("thedailynews", {"the": 50, "daily": 5, "news": 9, "then": 3}, 1000) == ["the", "daily", "news"]


def test_viterbi_by_brute_force():
    r = random.Random(6)
    for _ in range(300):
        label = "".join(r.choice("ab") for _ in range(r.randint(0, 9)))
        counts = {"".join(r.choice("ab") for _ in range(r.randint(1, 5))): r.randint(1, 40) for _ in range(r.randint(0, 6))}
        total = sum(counts.values()) + r.randint(0, 60) or 1

        def worth(words):
            return sum((math.log(counts[w]) if w in counts else math.log(10) - len(w) * math.log(10)) - math.log(total) for w in words)

        n = max(len(label) - 1, 0)
        cuts = [[0, *(i + 1 for i in range(n) if m >> i & 1), len(label)] for m in range(1 << n)]
        most = max(worth([label[a:z] for a, z in zip(c, c[1:]) if a < z]) for c in cuts)
        got = url_filter.viterbi(label, counts, total)
        assert "".join(got) == label and worth(got) == pytest.approx(most)
    long = "q" * 5000 + "news" + "z" * 3000
    assert url_filter.viterbi(long, {"news": 900}, 1000) == ["q" * 5000, "news", "z" * 3000]


def test_url_verdicts_by_brute_force(spark):
    """Naive Bayes over whole hosts and paths: digits, long words and hyphens count; hashed cells do not collide here."""
    r = random.Random(12)
    good, bad = ["garden", "recipes", "9to5"], ["casino", "x" * 40, "win7"]
    rows = []
    for i in range(160):
        block = i % 2
        words = [r.choice(bad if block else good) for _ in range(2)] + [r.choice(["shop", "page"])]
        rows.append((i, f"http://{'-'.join(words)}.{['com', 'net'][block] if i < 120 else 'io'}/{'en' if block else 'de'}/{i % 5}/{words[0]}", " "))
    rules = [("net", "/", "block"), ("com", "/", "allow")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in url_filter.judge(spark, pages, rules).collect()}
    counts = collections.Counter(w for _, u, _ in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"^.*?://[^/]*", "", u)))
    total = sum(counts.values())

    def tokens(u):
        host, path = re.match(r"^.*?://([^/]*)(.*)", u).groups()
        out = []
        for run in set(re.findall(r"[^\W\d_]+|\d+", host)):
            out += ["." + w for w in ([run] if run.isdigit() else url_filter.viterbi(run, counts, total))]
        return out + ["/" + w for w in re.findall(r"[^\W_]+", path)]

    table, prior = collections.defaultdict(lambda: [1, 1]), [1, 1]
    size = [url_filter.CELLS] * 2
    for i, u, _ in rows[:120]:
        prior[i % 2] += 1
        for t in tokens(u):
            table[t][i % 2] += 1
            size[i % 2] += 1
    for i, u, _ in rows[120:]:
        want = math.log(prior[1] / prior[0]) + sum(math.log(table[t][1] / size[1]) - math.log(table[t][0] / size[0]) for t in tokens(u))
        assert got[i].score == pytest.approx(want, abs=1e-5) and got[i].verdict == ("block" if want > 0 else "allow") == ["allow", "block"][i % 2]


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    rows, df, none = docs
    got = packing.pack(spark, df, window=256).toPandas()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert got["length"].sum() == sum(map(len, ids.values()))
    for r in got.itertuples():
        a = ids[r.doc_id]
        assert r.doc_tokens == len(a) and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert (g["start"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum()[:-1]])).all() and g["length"].sum() <= 256
    n = got["sequence_id"].nunique()
    assert got["length"].sum() >= 0.9 * 256 * (n - 1) and packing.pack(spark, none).count() == 0


def test_licenses(spark):
    mit = dict(reversed(licenses.TEMPLATES))["MIT"]
    rows = [(0, None), (1, ""), (2, "Some text.\nReleased under the MIT License.\nMore."), (3, mit), (4, "the licence of a bird"), (5, "LICENSED under: the Apache-License, version 2.0!"), (6, "x " * 5000 + "\nLicensed under CC BY-NC 4.0."), (2, "twice")]
    got = sorted((r.doc_id, r.license or "") for r in licenses.license_of(spark, table(spark, rows)).collect())
    assert got == [(0, ""), (1, ""), (2, ""), (2, "MIT"), (3, "MIT"), (4, ""), (5, "Apache-2.0"), (6, "CC-BY-NC-4.0")]
    assert licenses.license_of(spark, table(spark, [])).count() == 0


def test_licenses_inside_other_text(spark):
    names = collections.defaultdict(list)
    for n, t in licenses.TEMPLATES:
        names[n].append(t)
    full, r = max(names["MIT"], key=len), random.Random(3)
    wrapped = "\n".join("# " + " ".join(full.split()[i : i + 9]) for i in range(0, len(full.split()), 9))
    rows = [
        (0, "This software is released under the MIT License."),
        (1, "Some prose. Released under the MIT License. More prose."),
        (2, f"# A tool for many things\n# by someone\n{wrapped}\n# and here is the code of it\nimport os"),
        (3, "We say it is released\nunder the MIT\nLicense and go on with this and that."),
        (4, "First it was released under the MIT License. Licensed under CC BY 4.0. All of it."),
        (5, "The license of the bird under the tree is the right of any person to use, copy and sell it."),
        (6, "now released " + "x " * 900 + "under the mit license then"),
        *((i, " ".join(r.choice("released under the mit license all rights reserved x".split()) for _ in range(90))) for i in range(10, 60)),
    ]
    got = {x.doc_id: x for x in licenses.license_of(spark, table(spark, rows)).collect()}
    assert [(got[i].license, got[i].licenses, got[i].n_units) for i in range(6)] == [("MIT", ["MIT"], 1)] * 4 + [("MIT", ["CC-BY-4.0", "MIT"], 2), (None, [], 0)]
    bigrams = lambda t: list(zip(w := re.findall(r"[^\W_]+", t.lower()), w[1:]))
    for i, t in rows:
        if i >= 6:  # every window of every length
            b, most = bigrams(t), 0
            for _, x in licenses.TEMPLATES:
                x = set(bigrams(x))
                for s in range(len(b)):
                    a = set()
                    for y in b[s:] if b[s] in x else ():
                        a.add(y)
                        most = max(most, 2 * len(a & x) / (len(a) + len(x)))
            assert (got[i].dice or 0) == pytest.approx(most if most >= 0.8 else 0)
    assert sum(got[i].license is not None for i in range(10, 60)) > 3 and got[6].dice == pytest.approx(6 / 7)


@pytest.mark.parametrize(("k", "pct"), [(4, 85), (5, 80)])
def test_ngram_join(docs, spark, k, pct):
    components_match(spark, *docs, k, pct)


@pytest.mark.parametrize("core", [0.5, 0.1])
def test_ngram_join_by_differences(spark, monkeypatch, core):
    """Every open shingle goes through the rounds by pivots: groups of near copies with some edits just too many."""
    for name, value in {"STAR_ROUNDS": 0, "CROWDED": 0, "CORE": core}.items():
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(4)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(300)]
    out = [None, "", "one", "one"]
    for _ in range(3):
        base = [r.choice(words) for _ in range(90)]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(0, 90, 6)] = r.choice(words[:20])
            out.append(" ".join(w))
    rows = list(enumerate(out))
    components_match(spark, rows, table(spark, rows), table(spark, []), 4, 85)


def components_match(spark, rows, df, none, k, pct):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(spark, df, k, pct).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    if k == 5:
        assert sorted(r.doc_id for r in ngram_join.keep_one(spark, df, k, pct).collect()) == sorted(i for i in sets if root(i) == i)
        assert ngram_join.jaccard_components(spark, none, k, pct).count() == 0


@pytest.mark.parametrize("most", [60_000, 2])
def test_suffix_dedup(docs, spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)  # 2: crowded anchors, down to whole windows
    n = 60
    rows, df, none = docs
    if most == 2:
        rows = rows[:40] + rows[-30:]
        df = df.filter(df.doc_id.isin([i for i, _ in rows]))
    seen = collections.Counter(b[i : i + n] for _, t in rows if t for b in [t.encode()] for i in range(len(b) - n + 1))
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup_spans(spark, df, n, with_text=True).collect()}
    removed = 0
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 2, bool)
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                m[j + 1 : j + n + 1] = True
        rest = bytes(x for x, y in zip(b, m[1:-1]) if not y)
        assert got[i] == (len(b), int(m.sum()), int((np.diff(m.astype(int)) == 1).sum()), hashlib.sha256(rest).hexdigest(), None if t is None else rest.decode("utf-8", "ignore"))
        removed += m.sum()
    assert removed and suffix_dedup.dedup_spans(spark, none, n).count() == 0
    if most > 2:
        named = df.withColumnsRenamed({"key": "_key", "v": "_cut"})
        kept = suffix_dedup.without_repeats(spark, named, n)
        assert kept.columns == named.columns and suffix_dedup.without_repeats(spark, none, n).count() == 0
        for r in kept.collect():
            assert (r.text, r._key, r._cut) == (got[r.doc_id][4], "k", 1) and r.n_chars == len(r.text or "")


def test_language_id(spark):
    r = random.Random(2)
    words = {"aa": "the of and that with from".split(), "bb": "der die und nicht mit von".split(), "cc": "los las que con por una".split()}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(r.randint(4, 30))), x) for i, x in ((i, "abc"[i % 3] * 2) for i in range(240))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, "the of", None)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, score string")
    got = {x.doc_id: x for x in language_id.predict(spark, df).collect()}
    held = [(got[i].lang_pred, x) for i, _, x in rows if got[i].held_out and i < 900]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert language_id.predict(spark, df.limit(0)).count() == 0
    assert len(np.unique(language_id.codewords(40), axis=0)) == 40


def test_chat_round_trip(spark):
    bad = ["<|im_end|>", "<\\|", "<\\\\|<|", "a\\nb", "\\", "\n<|", "<|\\", "", None, "é<|im_start|>user\n"]
    rows = [(c, t, "assistant" if t % 2 else "user", bad[(c + t) % len(bad)]) for c in range(12) for t in range(4)] + [(None, 0, None, "x"), (50, None, "us\ner<|", "y")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, mask int")
    got = {r.conv_id: r for r in chat.digest(spark, df).collect()}
    assert set(got) == {*range(12), None, 50, -1}
    for c in got:
        turns = [(r or "", t or "") for k, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0))] if c != -1 else chat.PLANTED
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.compile_template("{% set a = 'x' + 'y' %}{% if 1 == 1 %}{{ a | upper }}{% else %}no{% endif %}")([]) == ("XY", [])
    for src in ("{{ a.__class__ }}", "{{ a | eval }}", "{% import os %}", "{% if a %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(src)


def test_toxicity(spark):
    r = random.Random(4)
    vocab, vile = ["".join(r.choice("abcdefghi") for _ in range(5)) for _ in range(800)], ["zzidiot", "zzscum", "zzmoron", "zztrash"]
    rows = []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))]
        if i % 5 == 0:
            for _ in range(r.randint(2, 9)):
                w.insert(r.randint(0, len(w)), r.choice(vile))
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (5, rows[5][1])]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(None, 1, 1), (7, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(spark, table(spark, rows), labels).collect()}
    wrong = sum(got[i].rejected != (i % 5 == 0) for i in range(300, 600))
    assert wrong <= 6 and not got[1000].rejected and not got[1001].rejected
    mild, severe = ([got[i].severity for i, t in rows[:600] if i % 5 == 0 and (sum(w in vile for w in t.split()) >= 7) == s] for s in (False, True))
    assert np.mean(severe) > np.mean(mild)
    assert toxicity.score(spark, table(spark, []), labels).count() == 0
    assert not any(x.rejected for x in toxicity.score(spark, table(spark, rows[:5]), labels.limit(0)).collect())
