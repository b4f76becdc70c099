"""Edge cases and brute force for the operators on small tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rulelens.llm import chat, mixing, quality, secret_ledger, set_join, site_quality, url_rules, vector_search

W = re.compile(r"[^\x20\x09-\x0d]+")
rng = random.Random(3)
VOCAB = [f"{a}{b}" for a in ("Alpha", "be", "cor", "den", "Éta", "fi") for b in ("ra", "lo", "x", "", "ne")]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(220)
    words = base.split()
    texts = [base, base, " ".join(words[:100] + ["new"] + words[101:]), None, "", " \n\t", "one", "one two", "x" * 5000, prose(30_000)]
    texts += [prose(80) for _ in range(20)] + ["line a\n" + prose(60) + "\nline a"] * 3
    rows = [(k, t, None if k % 7 == 0 else f"s{k % 3}", "clash", 1) for k, t in enumerate(texts)]
    rows += [(2, rows[2][1], "s2", "clash", 2), (2, rows[2][1], "s2", "clash", 2), (None, "a b c", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, _row int")


def collect(df):
    return [tuple(r) for r in df.collect()]


def test_mixing_matches_sorting(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    size = collections.Counter()
    for r in got:
        size[r.source] += r["size"]
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    fixed = {}
    while True:  # reshare until none is above three times its size
        left, w = total - sum(fixed.values()), sum(weight[s] for s in order if s not in fixed)
        target = {s: fixed.get(s, left * weight[s] / w if w else 0) for s in order}
        over = [s for s in order if s not in fixed and target[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    for s in order:
        rows = sorted([r for r in got if r.source == s], key=lambda r: r.key)
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 3 * r["size"] for r in rows)
        steps = [r.copies for r in rows]
        assert steps == sorted(steps, reverse=True) and max(steps) - min(steps) <= 1
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r["size"] for r in rows) * 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.take(docs.where("false")).count() == 0


def test_smaller_budgets_nest(docs):
    less = {r.key: r.copies for r in mixing.mix(docs, share=0.4).collect()}
    more = {r.key: r.copies for r in mixing.mix(docs, share=0.9).collect()}
    assert all(more[k] >= n for k, n in less.items())


def brute_quality(rows, min_docs, min_share=0.002, min_left=30):
    """Base counts, then: normalise lines, count distinct documents per host, remove lines above the limits, and
    reject documents that keep under ``min_left`` percent of their words. Documents are distinct if their texts are."""
    norm = lambda x: " ".join(W.findall(x)).translate({c: c + 32 for c in range(65, 91)})
    holders, hosts, out = collections.defaultdict(set), collections.defaultdict(set), []
    for _, t, host in rows:
        hosts[host].add(t or "")
        for x in (t or "").split("\n"):
            if W.search(x):
                holders[host, norm(x)].add(t or "")
    above = {k for k, texts in holders.items() if len(texts) > min_docs and len(texts) > min_share * len(hosts[k[0]])}
    for i, t, host in rows:
        w, lines = W.findall(t or ""), [x for x in (t or "").split("\n") if W.search(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = collections.Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        lost = sum(len(W.findall(x)) for x in lines if (host, norm(x)) in above)
        out.append((i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered), failed, not failed and (len(w) - lost) * 100 >= min_left * len(w)))
    return out


def test_quality_matches_brute_force(spark, docs):
    boiler = "Home About Contact " + " ".join(f"w{k}" for k in range(60))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rows += [(100 + k, f"{boiler}\n" + " ".join(f"u{k}x{j}" for j in range(k)), "s1") for k in range(12)]
    rows += [(150 + k, f"{boiler}\n{prose(300)}", "s1") for k in range(20)]
    copies = " ".join(f"c{j}" for j in range(120))
    rows += [(200 + k, copies.replace("c9 ", f"q{k} ") + "\nsame tail of all the copies here", "s0") for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judge(df, min_docs=5).select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_quality(rows, 5)))
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & set(range(100, 112)) and set(range(200, 215)) <= kept  # boilerplate goes, copies stay
    cleaned = quality.clean(df, min_docs=5)
    assert cleaned.columns == df.columns and cleaned.count() == sum(r.kept for r in got)
    assert quality.judge(df.where("false")).count() == 0


def test_boilerplate_of_distinct_documents(spark):
    rows = []
    for host, share in (("h80", 80), ("h90", 90), ("h95", 95)):
        block = " ".join(f"{host}w{k}" for k in range(share))
        rows += [(len(rows) + k, block + "\n" + " ".join(f"{host}d{k}x{j}" for j in range(100 - share)), host) for k in range(60)]
    rows += [(1000 + k, rows[0][1].replace("h80", "h1"), "copies") for k in range(60)]  # one text only
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t, host in rows:
        lost = 0 if host == "copies" else len(t.split("\n")[0].split())
        assert (got[i].lost_words, got[i].kept) == (lost, not lost)
    assert {r.doc_id for r in quality.clean(df).collect()} == set(range(1000, 1060))


def test_copies_do_not_move_the_share(spark):
    block = " ".join(f"b{k}" for k in range(60))
    rows = [(k, f"{block}\n" + " ".join(f"u{k}x{j}" for j in range(20)), "hot") for k in range(8)]
    rows += [(100 + k, " ".join(f"v{k}x{j}" for j in range(80)), "hot") for k in range(91)]
    rows += [(1000 + k, " ".join(f"c{j}" for j in range(80)), "hot") for k in range(900)]  # 100 distinct texts
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, lost in ((0.07, set(range(8))), (0.08, set())):  # 8 of 100
        got = quality.judge(df, min_docs=5, min_share=share).where("lost_words > 0").collect()
        assert {r.doc_id for r in got} == lost


def test_repeats_by_both_ways(spark):
    texts = ["a b c a b c", "a a a a a a", " ".join("x y".split() * 400), " ".join(f"w{k % 97}" for k in range(600)), prose(500), "p q r s"]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(df).collect()}
    assert got == {i: x[4] for i, x in zip(got, brute_quality([(k, texts[k], "s") for k in got], 20))}


SECRETS = [
    "password = hunter22 and PASSWD:'abcdef' secret=token:abcdefgh token=\"zzzzzz", "AKIA" + "A1" * 8 + " AKIAAKIA AKIA", "é🙂 api_key: 0123456789abcdef0123456789abcdef x",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, None, "", "api-key=zzzzzzz apikey==zzzzzzz", "deadbeef" * 400, "sk_live_" + "Z" * 20,
]
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_and_ledger(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(SECRETS)] + [(50 + k, SECRETS[0], None) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    ledger = str(tmp_path / "ledger")
    first = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_ledger.scan(df).collect()}
    for k, t, _ in rows:
        assert [s for s in first[k] if s[1] < 3] == base_spans(t)
    some = secret_ledger.scan(df.where("doc_id < 3"), rules=secret_ledger.RULES[:2], ledger=ledger)
    assert some.count() == 3
    n = spark.read.parquet(ledger).count()
    assert n == 3
    more = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_ledger.scan(df, ledger=ledger).collect()}
    assert more == first
    again = secret_ledger.scan(df, ledger=ledger).count()
    written = spark.read.parquet(ledger)
    assert again == len(rows) and written.select("blob", F.explode("scanned")).distinct().count() == written.select("blob", F.explode("scanned")).count()
    masked = {r.doc_id: r.text for r in secret_ledger.redact(df).collect()}
    assert masked[4] == "[SECRET]" and masked[6] == "" and masked[5] is None and masked[2].startswith("é🙂 [SECRET]")
    assert "hunter22" not in masked[50] and secret_ledger.scan(df.where("false")).count() == 0


def brute_spans(text, rules):
    """Spans of every rule by Python's own regular expressions, kinds by place in ``rules``."""
    out = set()
    for k, r in enumerate(rules):
        pattern = r.pattern.replace("(?i)", "") if r.group else r.pattern
        for m in re.finditer(pattern, text or "", re.I if r.pattern.startswith("(?i)") else 0):
            if len(m[r.group]) >= r.least:
                out.add((m.start(), k, m.end()))
    return sorted(out)


def test_every_kind_matches_brute_force(spark):
    texts = [*SECRETS, "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9 + " AIza" + "x" * 35, "xoxb-1234567890ab xox-1", "ghp_short gho_" + "Z9" * 20, "é" * 40 + " secret: sk_live_" + "q" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secret_ledger.scan(df).collect()}
    assert got == {k: brute_spans(t, secret_ledger.RULES) for k, t in enumerate(texts)}
    assert {x[1] for v in got.values() for x in v} == set(range(len(secret_ledger.RULES)))


def test_ledger_follows_changed_rules(spark, tmp_path):
    a, b = secret_ledger.Rule("a", "[xy]+", 0, 2), secret_ledger.Rule("b", "q[0-9]+", 0, 1)
    wider = secret_ledger.Rule("a", "[xyz]+", 0, 2)
    df = spark.createDataFrame([(1, "xyxyx z q1"), (2, "zzz xx q22"), (3, None)], "doc_id long, text string")
    told = lambda d, rules, **o: {r.doc_id: [tuple(x) for x in r.spans] for r in secret_ledger.scan(d, rules=rules, **o).collect()}
    ledger = str(tmp_path / "changed")
    for docs, rules in ((df.where("doc_id < 2"), (a, b)), (df, (wider, b)), (df, (b, a)), (df, (b,)), (df, (a, b, wider)), (df.where("doc_id > 1"), (wider, a))):
        want = {r.doc_id: brute_spans(r.text, rules) for r in docs.collect()}
        assert told(docs, rules, ledger=ledger) == told(docs, rules) == want
    written = spark.read.parquet(ledger).select("blob", F.explode("scanned").alias("version"))
    assert written.count() == written.distinct().count() == 9  # three blobs by three versions
    spark.read.parquet(ledger).write.mode("append").parquet(str(tmp_path / "twice"))
    spark.read.parquet(ledger).write.mode("append").parquet(str(tmp_path / "twice"))  # as two runs at once would leave it
    assert told(df, (wider, b), ledger=str(tmp_path / "twice")) == told(df, (wider, b))


def test_redact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "secret: abcdefgh", "s", "b", "d", 7)], "doc_id long, text string, _spans string, _blob string, doc string, spans int")
    got = secret_ledger.redact(df).collect()
    assert [tuple(r) for r in got] == [(1, "[SECRET]", "s", "b", "d", 7)] and secret_ledger.redact(df).columns == df.columns
    assert secret_ledger.redact(df.withColumnRenamed("_spans", "blob").withColumnRenamed("_blob", "a.b")).columns == ["doc_id", "text", "blob", "a.b", "doc", "spans"]


def brute_links(texts, n, percent):
    sets = {}
    for k, t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in W.findall(t or "")]
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_wide_index_entries(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(set_join, "PART", 12)
    possible = set_join._possible_links

    def bounded(percent):
        def run(batches):
            seen = collections.Counter()
            for batch in batches:
                seen.update(batch.column("key").to_pylist())
                assert max(seen.values(), default=0) <= 24, "an entry of more than two parts in one task"
                yield from possible(percent)(iter([batch]))

        return run

    monkeypatch.setattr(set_join, "_possible_links", bounded)
    rows = []
    for group in range(3):  # one group of 90 near copies, two of 30, each set with one word of its own
        words = [f"g{group}w{j}" for j in range(200)]
        rows += [(len(rows) + k, " ".join([*words[:150], f"own{group}x{k}", *words[150:]])) for k in range(30 if group else 90)]
    rows += [(500 + k, " ".join(f"z{k}y{j}" for j in range(180))) for k in range(30)]  # alone
    sets = {i: set_join.shingles(t, 3) for i, t in rows}
    table = spark.createDataFrame([(i, len(x), bytearray(set_join.sketch(x))) for i, x in sets.items()], "node long, n_shingles long, sketch binary")
    shared = spark.createDataFrame([(7, i) for i in sets] + [(8, i) for i in sets if i < 20], "key long, node long")
    entry, order = set_join.Entries(90), sorted(sets)
    entry.add(order, [len(sets[i]) for i in order], [set_join.sketch(sets[i]) for i in order])
    want = {i: entry.find(i) for i in order}
    got = {r.node: r.component for r in set_join.clusters_of(shared, table, 90).collect()}
    assert {i: got.get(i, i) for i in order} == want and len(set(want.values())) == 3 + 30
    # members that are connected already are no pairs
    bits = np.stack([np.frombuffer(set_join.sketch(sets[i]), np.uint64) for i in range(90)])
    pairs = list(set_join.dual(set_join.Tree(bits, np.full(90, len(sets[0])), np.zeros(90, np.int64)), None, 90))
    assert not sum(len(i) for i, _ in pairs)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_set_join(spark, n, percent, monkeypatch):
    monkeypatch.setattr(set_join, "PART", 12)  # so that large clusters are cut into parts
    monkeypatch.setattr(set_join, "SHARED", 200)
    texts = []
    for size in (4, 9, 12, 40, 150):
        words = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(18):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + size // 25)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: size - rng.randrange(0, 1 + size // 20)]))
    texts += [None, "", " ", "A b", "a B", texts[0], texts[0].upper(), prose(3000)]
    rows = [(k * 3 + 1, t, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.link(df, n, percent).collect()}
    want = brute_links([(k, t) for k, t, _ in rows], n, percent)
    assert got == want
    left = set_join.one_of_each(df.unionByName(df.where("doc_id = 1")), n, percent)
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()}) and left.columns == df.columns
    assert set_join.link(df.where("false"), n, percent).count() == 0


def test_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, ""), (3, b), (3, c), (3, c), (4, None), (4, None), (5, a), (None, b), (None, b)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _filled int")
    left = set_join.one_of_each(df)
    # 2 and 5 hold the text of 1 and go, but for the empty row of 2; 3 keeps both its texts once; rows without an id stay
    assert sorted(((r.doc_id or 0, r.text or "") for r in left.collect())) == sorted([(1, a), (2, ""), (3, b), (3, c), (4, ""), (0, b), (0, b)])
    assert left.columns == df.columns


def test_pigeonhole_holds_for_every_size():
    for percent in (80, 90):
        for size in [*range(1, 60), 137, 500, 2000]:
            k = set_join.size_class(size, percent)
            low, high = set_join.size_range(k, percent)
            assert low <= size <= high
            for other in range(size, size * 100 // percent + 1):
                assert set_join.size_class(other, percent) - k in (0, 1)
                blocks, slack, _ = set_join.blocks_of(k, percent)
                assert blocks - (100 - percent) * (size + other) // (100 + percent) > slack


CHAT = [
    (1, 0, "system", "Be <|turn:user|> brief & [INST]"), (1, 1, "user", "hi " * 300), (1, 2, "assistant", "&lt; <|end|>\n ok"), (1, 3, "user", "x " * 900), (1, 4, "assistant", "y " * 200), (1, 5, "assistant", None),
    (2, 0, "assistant", ""), (2, 1, None, "t"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "us|>er", "null conversation"), (4, None, "user", "no turn"),
] + [(9, k, "assistant" if k % 2 else "user", f"{k} " * (k % 40)) for k in range(400)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    told = {r.conv_id: r for r in chat.read_back(chat.windows(df)).collect()}
    for c in {r[0] for r in CHAT}:
        rows = sorted([r for r in CHAT if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in told[c].turns] == [(r[2] or "", r[3] or "") for r in rows]
        assert told[c].loss == [r[3] or "" for r in rows if r[2] == "assistant"]
    made = chat.windows(df).where("conv_id = 9").orderBy("window").collect()
    assert len(made) > 5 and all("again:" in r.formatted for r in made[1:])
    assert all(r.formatted.startswith("<|again:system|>") for r in chat.windows(df).where("conv_id = 1 and window > 0").collect())
    assert chat.windows(df.where("false")).count() == 0


def test_windows_keep_the_budget(spark):
    """No window exceeds its budget by more than one turn that can't be split; the system turn is the only other such."""
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 30)):
            n = rng.choice([0, 1, 5, 20, 45, 90, 130]) if turn or conv % 3 else (30 if conv % 2 else 110)
            rows.append((conv, turn, "system" if not turn and conv % 3 == 0 else rng.choice(["user", "assistant"]), "w " * n))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    size = {(c, t): len(x.split()) + chat.MARKERS for c, t, _, x in rows}
    assert chat.windows(spark.createDataFrame([(1, 0, "system", "s " * 896)] + [(1, 1 + k, "user", "u " * 86) for k in range(20)], df.schema)).agg(F.max("tokens")).first()[0] <= 1024
    for budget, history in ((100, 30), (100, 0), (64, 16)):
        told = collections.defaultdict(list)
        for r in chat.windows(df, budget, history).collect():
            pieces = r.formatted.split(chat.END)[:-1]
            told[r.conv_id].append((r.window, r.tokens, [(p.split("|>")[0], len(p.split("\n", 1)[1].split()) + chat.MARKERS) for p in pieces]))
        for conv, made in told.items():
            made.sort()
            assert [w for w, _, _ in made] == list(range(len(made)))
            system = size[conv, 0] if (conv, 0, "system") in {(c, t, role) for c, t, role, _ in rows} else 0
            assert sum(n for _, _, ps in made for h, n in ps if h.startswith("<|turn:")) == sum(v for (c, _), v in size.items() if c == conv)
            for w, tokens, pieces in made:
                own = [n for h, n in pieces if h.startswith("<|turn:") and not h.endswith(":system")]
                assert tokens == sum(n for _, n in pieces) and sum(h.endswith(":system") for h, _ in pieces) == bool(system)
                assert tokens <= budget or len(own) <= 1, (conv, w, tokens, own)  # one turn, whole, beside system and history
                if system < budget and all(n <= (budget - system) * (budget - history) // budget - 1 for n in own):
                    assert tokens <= budget


URLS = [
    None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://xcom/en/", "http://a.com/en", "x://b.example.net/de/81", "x://example.net/de/9",
    "https://org/es/#a", "http://cheap-pills.example.org/a", "http://a.spam-farm.net/en/", "http://ok.org/wp-login.php", "http://a.com?/en/", "a://b.com/x://c.com/en/", "http://é.COM/en/ü", "http://" + "a" * 5000 + ".com/en/1",
]


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(3, URLS[4], "x")] * 2 + [(None, URLS[4], None)], "page_id long, url string, token string")
    got = url_rules.judge(df, url_rules.rule_table(spark)).collect()
    assert len(got) == df.count()
    for r in got:
        host, path = "", ""
        if r.url and "://" in r.url:
            rest = r.url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.PREFIX_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(re.search(p, host + path) for _, p, _ in url_rules.PATTERN_RULES) else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), r
    assert url_rules.judge(df.where("false"), url_rules.rule_table(spark)).count() == 0


def fitting(parsed):
    """Strings that a parsed expression fits, with each alternative, and with repeats left out, once and twice."""
    made = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "NOT_LITERAL":
            some = ["q", "."]
        elif op == "IN":
            negated = str(arg[0][0]) == "NEGATE"
            some = ["q", "."] if negated else [chr(x) for _, x in arg]
        elif op == "SUBPATTERN":
            some = fitting(arg[3])
        elif op == "BRANCH":
            some = [x for way in arg[1] for x in fitting(way)]
        elif op == "MAX_REPEAT":
            one, (low, high) = fitting(arg[2]), arg[:2]
            some = [x * n for n in (0, 1, 2) if low <= n <= high for x in one]
        else:
            assert op == "AT", op
            some = [""]
        made = [a + b for a in made for b in some]
    return made


def test_every_way_to_fit_is_filed(spark):
    ways = collections.defaultdict(list)
    for r in url_rules.rule_table(spark).collect():
        ways[r.pattern].append(set(r.tokens))
    assert len(ways) == len(url_rules.PREFIX_RULES) + len(url_rules.PATTERN_RULES)
    for pattern, sets in ways.items():
        for x in fitting(re._parser.parse(pattern)):
            for y in (x, x + "5x", x + "/a", x + "com/", x + "-b"):
                assert re.search(pattern, y)
                assert any(t <= set(re.findall(url_rules.TOKEN, y.lower())) for t in sets), (pattern, y)


def test_urls_of_open_ends(spark):
    urls = ["http://cheappills.com/", "http://cheap-pills.com/", "http://a.cheappills-b.com/x", "http://x.test/wp-login.php5", "http://x.test/a/wp-login.phpx", "http://cheappillsx.com/", "http://wp.test/login"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(df, url_rules.rule_table(spark)).collect()}
    assert got == dict(enumerate(["block"] * 5 + ["allow"] * 2))


def test_vector_search(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(700, 16)) * r.uniform(0.5, 2, size=(700, 1))
    x[100:160] = x[100]
    rows = [(k, [float(a) for a in v], "clash") for k, v in enumerate(x)]
    odd = [(800, None, ""), (801, [0.0] * 16, ""), (802, [None] * 16, ""), (803, [float("nan")] * 16, ""), (804, [float("inf")] + [1.0] * 15, ""), (805, [1.0] * 3, ""), (806, [], ""), (None, rows[3][1], "")]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>, codes string")
    got = collections.defaultdict(list)
    for q in vector_search.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert [i for _, i, _ in found] == best and [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s[i] - v) < 1e-12 for _, i, v in found)
    assert vector_search.search(df.where("false"), df).count() == 0
    few = df.where("vec_id < 4")
    assert vector_search.search(few, few.where("vec_id = 0")).count() == 3


def test_recall_where_the_quantiser_decides(spark):
    import numpy as np

    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 32)) * r.uniform(0.5, 2, size=(3000, 1))
    x[7], x[11] = 1e-170 * r.normal(size=32), 1e200 * r.normal(size=32)
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked, want = [*range(0, 3000, 20), 7], {}
    for q in asked:
        s = (x * x[q]).sum(axis=1)
        want[q] = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
    ask = df.where(F.col("vec_id").isin(asked))

    def recall(**o):
        got = collections.defaultdict(dict)
        for row in vector_search.search(df, ask, **o).collect():
            got[row.query_id][row.rank] = row.vec_id
        assert set(got) == set(asked) and all(sorted(g) == list(range(1, 21)) for g in got.values())
        return sum(len(set(got[q].values()) & set(want[q])) for q in asked) / 20 / len(asked)

    assert recall(vector_block=1000, query_block=64, rerank=120) >= 0.9  # several blocks, an eighth reranked
    assert recall(vector_block=1000, query_block=64, rerank=3000) == 1  # the exact way


def test_huge_components_have_a_defined_order(spark):
    big = [[1e200, 1e200], [1e200, -1e200], [-1e200, 1e200], [1.0, 2.0], [1e-320, 0.0]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in vector_search.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 4), (0, 3, 1), (0, 4, 2)]


def test_posteriors_match_brute_force(spark):
    """The classifier's second part, from its evidence: sums, strengths by moments, and a document's own part taken out."""
    import math

    class Said:  # evidence by text, in place of fitted models
        def evidence(self, text):
            return float(len(text) % 13 - 6), -1.0

    rows = [(k, "x" * (k * 7 % 41), f"h{k % 5}" if k < 90 else f"alone{k}", "en" if k % 3 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    sigmoid, logit = (lambda x: 1 / (1 + math.exp(-x))), (lambda p: math.log(p / (1 - p)))
    p = {i: sigmoid(len(t) % 13 - 6) for i, t, _, _ in rows}
    host, path = {i: h for i, _, h, _ in rows}, {i: (h, g) for i, _, h, g in rows}

    def sums(of):
        out = collections.defaultdict(lambda: [0.0, 0])
        for i in p:
            out[of[i]][0] += p[i]
            out[of[i]][1] += 1
        return out

    def strength(groups, prior):
        n = sum(g[1] for g in groups.values())
        spread = sum(g[1] * (g[0] / g[1] - prior[k]) ** 2 for k, g in groups.items())
        chance = sum(g[0] / g[1] * (1 - g[0] / g[1]) for g in groups.values())
        between = (spread - chance) / n
        most = sum(g[1] * prior[k] * (1 - prior[k]) for k, g in groups.items()) / n
        return min(1e6, max(1.0, most / between - 1)) if between > 0 else 1e6

    total, hosts, paths = sum(p.values()), sums(host), sums(path)
    prior = total / len(p)
    a = strength(hosts, dict.fromkeys(hosts, prior))
    posterior = {h: (s + a * prior) / (n + a) for h, (s, n) in hosts.items()}
    b = strength(paths, {k: posterior[k[0]] for k in paths})
    for r in site_quality.classify(df, Said()).collect():
        i = r.doc_id
        corpus = (total - p[i]) / (len(p) - 1)
        of_host = (hosts[host[i]][0] - p[i] + a * corpus) / (hosts[host[i]][1] - 1 + a)
        of_path = (paths[path[i]][0] - p[i] + b * of_host) / (paths[path[i]][1] - 1 + b)
        want = sigmoid(logit(p[i]) + site_quality.SITE_WEIGHT * (logit(of_path) - logit(corpus)))
        assert abs(r.quality - want) < 1e-9 and abs(r.host_posterior - posterior[host[i]]) < 1e-9
        assert r.path_posterior == pytest.approx((paths[path[i]][0] + b * posterior[host[i]]) / (paths[path[i]][1] + b))
        assert i < 90 or r.quality == pytest.approx(p[i])  # a site of one document says nothing
    one = spark.createDataFrame(rows[:1], df.schema)
    assert site_quality.classify(one, Said()).first().quality == pytest.approx(p[0])


def test_site_quality_holds_out(spark):
    good, bad = [prose(60) for _ in range(300)], [" ".join(w + "###" for w in prose(60).split()) for _ in range(120)]
    toxic = [prose(40) + " idiot " + prose(10) for _ in range(120)]
    texts = [(t, q, x) for ts, q, x in ((good, 1, 0), (bad, 0, 0), (toxic, 1, 1)) for t in ts]
    rng.shuffle(texts)
    rows = [(k, t, f"h{k % 9}", "en") for k, (t, _, _) in enumerate(texts)]
    df = spark.createDataFrame(rows + [(-1, None, None, None), (-2, "", "h0", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, q, x) for k, (_, q, x) in enumerate(texts) if k % 2], "doc_id long, quality int, toxic int")
    models = site_quality.train(df, labels)
    got = {r.doc_id: r.kept for r in site_quality.classify(df, models).collect()}
    held = [(k, q == 1 and x == 0) for k, (_, q, x) in enumerate(texts) if k % 2 == 0]
    assert sum(got[k] == want for k, want in held) >= 0.97 * len(held) and len(got) == len(rows) + 2
    assert site_quality.classify(df.where("false"), models).count() == 0
