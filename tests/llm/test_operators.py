"""Edge rows and brute force for the training-data operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tessellum.llm import credentials, langid, licenses, lm, media, mixing, pieces, quality, queries, simhash, urls

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_takes_empty_tables_and_edge_rows(docs, none):
    model = langid.train(docs)
    lm_model, counts = lm.train(docs, steps=5)
    runs = {
        "langid": lambda d: langid.identify(d, model),
        "urls": lambda d: urls.judge(d, "doc_id", "text"),
        "mixing": mixing.mix,
        "pieces": pieces.encode,
        "media": lambda d: media.search(d.withColumn("media", F.col("text").cast("binary")), every=1),
        "simhash": simhash.near_duplicates,
        "credentials": lambda d: credentials.digest(credentials.scan(d)),
        "quality": quality.judged,
        "licenses": licenses.scan,
        "lm": lambda d: lm.score(d, lm_model, counts),
    }
    for name, run in runs.items():
        assert run(docs).count() == docs.count(), name
        assert run(none).count() == 0, name
    assert langid.identify(docs, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    empty, no_counts = lm.train(none, steps=2)
    assert lm.score(docs, empty, no_counts).where("n_known > 0").count() == 0


def test_langid_learns_and_knows_no_letter(real):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    found = langid.identify(real.where(held), langid.train(real.where(~held)), keep={"lang": F.col("lang")}).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.9 * len(found)
    assert langid.train(real).predict(["123 !?", ""]) == [("und", 0.0)] * 2


def test_langid_filter_has_no_false_negative_and_few_false_positives():
    made = langid.Filter.of({"a": np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), "b": np.zeros(0, np.uint64)}, "a", slots=1 << 16)
    held = made.masks(np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert (held[0] & np.uint64(1)).all() and not (held[0] & np.uint64(2)).any()
    other = made.masks(np.arange(10_000, 20_000, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    assert (other[0] & np.uint64(1)).mean() < 0.02


def test_langid_learns_single_short_texts_and_more_than_64_languages(spark):
    few = [("the cat sat on the mat", "en"), ("der hund schläft im haus", "de"), ("le chat dort dans la maison", "fr")]
    model = langid.train(spark.createDataFrame(few, "text string, lang string"))
    assert [x for x, _ in model.predict([t for t, _ in few])] == [x for _, x in few]
    word = lambda i, k: "".join(chr(97 + int(c)) for c in f"{i * 7919 + k * 104729:09d}")
    many = [(" ".join(word(i, k) for k in range(12)), f"l{i:03d}") for i in range(150)]
    model = langid.train(spark.createDataFrame(many, "text string, lang string"))
    assert [x for x, _ in model.predict([t for t, _ in many])] == [x for _, x in many]


def test_langid_equals_votes_by_plain_sets(spark, real):
    rows = real.where("text is not null and lang is not null").collect()

    def grams_of(text):
        flat = "".join(c if c.isalpha() else " " for c in text.lower())
        flat = " " * 3 + flat + " " * 3
        return [g for g in (flat[i : i + 4] for i in range(len(flat) - 3)) if sum(c != " " for c in g) >= 2]

    counts = defaultdict(Counter)
    for text, lang in {(r.text, r.lang) for r in rows}:
        counts[lang].update(grams_of(text))
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for c in rate.values():
        for g, v in c.items():
            top[g] = max(top[g], v)
    held = {x: {g for g, v in c.items() if v >= langid.SHARE * top[g]} for x, c in rate.items()}
    model = langid.train(real, grams_kept=10**7)
    texts = sorted({r.text for r in rows})
    for text, (found, score) in zip(texts, model.predict(texts), strict=True):
        g = grams_of(text)
        votes = {x: sum(y in held[x] for y in g) / max(1, len(g)) for x in held}
        if g and max(votes.values()):
            assert votes[found] >= max(votes.values()) - 0.02 and abs(score - votes[found]) <= 0.05


def test_urls_rules_parts_and_model(spark):
    rows = ["HTTP://WWW.Example.com/en/1?q", "http://m.example.com/en/x", "http://example.com/fr/", "http://a.net/es/1", "http://netx/es/", "com/", None, "x://com", "http://c.org/a#b", "http://a.b?c/d"]
    found = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")).orderBy("page_id").collect()
    assert [r.rule for r in found] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, None, None]
    assert [(r.host, r.path) for r in found[4:]] == [("netx", "/es/"), ("", ""), ("", ""), ("com", ""), ("c.org", "/a"), ("a.b", "")]
    train = [(f"h{i}.x", "/good/", False) for i in range(50)] + [(f"h{i}.x", "/evil/", True) for i in range(50)]
    model = urls.Model.fit(train)
    bad, good = model.scores(["new.y", "new.y"], ["/evil/", "/good/"])
    assert bad > 0.5 > good


def test_urls_slots_and_scores_equal_brute_force():
    def plain(host, path, n):
        out = set()
        for mark, text in ((1, host), (2, path)):
            raw = f"^{text}$".encode()
            for k in urls.GRAMS:
                for i in range(len(raw) - k + 1):
                    h = mark * 16 + k
                    for c in raw[i : i + k]:
                        h = (h ^ c) * 0x9E3779B97F4A7C15 % 2**64
                        h ^= h >> 29
                    out.add(h % n)
        return out

    table = urls.labelled_urls() + [("", "", False), ("ünï.de", "/ß", True)]
    row, col = urls.slots([h for h, *_ in table], [p for _, p, _ in table], 4096)
    assert all({int(c) for c in col[row == i]} == plain(h, p, 4096) for i, (h, p, _) in enumerate(table))
    model = urls.Model.fit(urls.labelled_urls())
    for (h, p, _), score in zip(table, model.scores([h for h, *_ in table], [p for _, p, _ in table]), strict=True):
        at = plain(h, p, urls.SLOTS)
        assert math.isclose(score, 1 / (1 + math.exp(-(model.bias + sum(model.weights[x] for x in at) / math.sqrt(max(1, len(at)))))), rel_tol=1e-9)


def test_urls_model_knows_held_out_labelled_urls():
    table, right = urls.labelled_urls(), 0
    for fold in range(5):
        test = table[fold::5]
        model = urls.Model.fit([x for i, x in enumerate(table) if i % 5 != fold])
        right += sum((s > 0.5) == b for s, (*_, b) in zip(model.scores([h for h, *_ in test], [p for _, p, _ in test]), test, strict=True))
    assert len(table) < 200 and right >= 0.85 * len(table), right / len(table)


def test_mixing_meets_targets_and_reruns_agree(spark, real):
    first = mixing.mix(real).collect()
    again = mixing.mix(real.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in real.collect()}
    taken, target, most, total = defaultdict(int), {}, defaultdict(int), 0
    for r in first:
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        target[s], most[s], total = r.target, max(most[s], r.size), total + r.size
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= most[s] for s in taken)


def brute_force_mix(spark, rows, weights, max_copies, seed):
    """(source, size, weight) rows with different texts as Counter of (doc_id, taken), by sorting all Pareto ranks; scales by bisection."""
    sizes, order = defaultdict(int), sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    for r in rows:
        sizes[r.source] += r.size
    given, left, cap, target = {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(sizes.values()), set(), {}
    while True:
        level = (left - sum(max_copies * sizes[s] for s in cap)) / max(1e-9, sum(given[s] for s in order if s not in cap))
        more = {s for s in order if s not in cap and level * given[s] > max_copies * sizes[s]}
        if not more:
            break
        cap |= more
    target = {s: max_copies * sizes[s] if s in cap else level * given[s] for s in order}
    out = Counter()
    for s in order:
        mine = [r for r in rows if r.source == s]
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(mid * r.weight, max_copies) * r.size for r in mine) < target[s] else (lo, mid)
        m = [min(hi * r.weight, max_copies) for r in mine]
        whole = [math.floor(x + 1e-6) for x in m]
        rest, upto, ranked = target[s] - sum(w * r.size for w, r in zip(whole, mine, strict=True)), 0, []
        for r, x, w in zip(mine, m, whole, strict=True):
            if x - w > 1e-6 and r.size:
                p, u = x - w, ((r.hash % (1 << 64) >> 11) + 0.5) / (1 << 53)
                ranked.append(((u / (1 - u)) / (p / (1 - p)), r))
        extra = set()
        for _, r in sorted(ranked, key=lambda z: z[0]):
            if upto + r.size / 2 > rest:
                break
            extra.add(r.number)
            upto += r.size
        for r, w in zip(mine, whole, strict=True):
            out[r.doc_id, (w + (r.number in extra)) * r.size] += 1
    return out


@pytest.mark.parametrize("weighted", [True, False])
def test_mixing_equals_brute_force_with_unequal_probabilities(spark, real, weighted):
    table = real.withColumn("w", F.pmod(F.col("doc_id"), F.lit(5)) + 0.5)
    size = mixing.n_words(F.col("text"))
    key = [F.xxhash64(F.lit(k), F.col("doc_id").cast("long"), "source", "text") for k in (1, 2)]
    rows = table.select("doc_id", "source", size.alias("size"), (F.col("w") if weighted else mixing.length_weight(size)).alias("weight"), F.xxhash64(F.lit(17), *key, F.lit(1).cast("long")).alias("hash"), F.monotonically_increasing_id().alias("number"))
    found = mixing.mix(table, weight_col="w" if weighted else None)
    expected = brute_force_mix(spark, rows.collect(), (5, 2, 1), 3, 17)
    assert Counter((r.doc_id, r.taken) for r in found.collect()) == expected
    assert len({taken for _, taken in expected}) > 3


def test_mixing_draws_repeated_and_null_ids_each_on_its_own(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(10))
    rows = [(None, text(i), "a") for i in range(300)] + [(7, text(0), "b") for _ in range(300)] + [(i, text(i), "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs)
    assert found.count() == 900
    by_source = defaultdict(lambda: [0, 0.0])
    for r in found.collect():
        key = "a" if r.doc_id is None else "b" if r.target < 9000 * 2 / 8 + 1 and r.target > 9000 / 8 + 1 else "c"
        by_source[key][0] += r.taken
        by_source[key][1] = r.target
    assert sum(abs(t - target) <= 10 for t, target in by_source.values()) == 3
    mixed = Counter(r.source for r in mixing.mixed_documents(docs).collect())
    assert {k: 10 * n for k, n in mixed.items()} == {k: t for k, (t, _) in by_source.items()}


def test_mixing_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), 3).collect()}
    assert found["a"] == 30 and found[None] == 15
    assert math.isclose(found["b"], (2015 - 45) * 2 / 3) and math.isclose(found["c"], (2015 - 45) / 3)


def test_pieces_viterbi_is_optimal_and_round_trips(docs):
    v = pieces.Vocabulary.read()
    score, least = {p: s for p, s, _ in v.pieces}, min(s for _, s, _ in v.pieces) - pieces.UNKNOWN
    name = {i: p for p, _, i in v.pieces}

    def best(text):
        out = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            out[end] = max([out[a] + score[text[a:end]] for a in range(max(0, end - 20), end) if text[a:end] in score] + ([out[end - 1] + least] if text[end - 1] not in score else []))
        return out[-1]

    for text in ("hello world", "Straße 12", "the  quick\nbrown", "🙂 ok"):
        ids = np.frombuffer(v.encode(text), np.int32)
        got, run = 0.0, 0
        for i in ids.tolist():
            if i in name:
                got += score[name[i]]
            else:
                run += 1
        unknown = sum(c not in score for c in (" " + text).replace(" ", pieces.MARK))
        assert math.isclose(got + unknown * least, best((" " + text).replace(" ", pieces.MARK)), rel_tol=1e-6) and (run > 0) == (unknown > 0)
        assert sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).decode(ids.tolist()) == text
    found = pieces.decode(pieces.encode(docs), text_col="decoded").collect()
    assert all(r.exact in (True, None) for r in found)
    assert Counter(r.decoded for r in found) == Counter(r.text for r in docs.collect())


def test_media_finds_aligned_recordings():
    random = np.random.default_rng(1)
    base = [random.integers(0, 256, random.integers(3000, 9000)).astype(np.uint8) for _ in range(40)]
    copies = [x[64 * k + 7 :].copy() for k, x in enumerate(base[:20])]
    for x in copies:
        x[random.integers(0, len(x), 5)] ^= 8
    items = [media.integers(x) for x in base + copies]
    q, r, offset, _ = media.align(items, items, 0.2, 16)
    found = {(int(a), int(b)) for a, b in zip(q, r, strict=True)}
    true = set()
    for a, x in enumerate(items):
        for b, y in enumerate(items):
            for off in range(-len(x) + 16, len(y) - 15):
                s = max(0, -off)
                n = min(len(x), len(y) - off) - s
                if n >= max(16, min(len(x), len(y)) / 2) and np.bitwise_count(x[s : s + n] ^ y[s + off : s + off + n]).mean() / 32 <= 0.2:
                    true.add((a, b))
                    break
    assert found <= true and len(found & true) >= 0.9 * len(true) and sum(a != b for a, b in true) >= 30
    assert dict(zip(zip(q.tolist(), r.tolist(), strict=True), offset.tolist(), strict=True))[0, 40] == 0


def test_media_votes_count_all_equal_places():
    random = np.random.default_rng(5)
    for _ in range(30):
        a, b = (np.repeat(random.integers(0, 4, 12), random.integers(1, 9, 12)).astype(np.uint32) for _ in range(2))
        full = Counter()
        for high in (0, 1):
            x, y = ((v >> np.uint32(14) if high else v & np.uint32((1 << 18) - 1)) for v in (a, b))
            for i in range(len(x)):
                for j in range(len(y)):
                    full[j - i] += int(x[i] == y[j])
        (_,), (_,), (offset,), _ = media.align([a], [b], 1.0, 0)[:4] if len(media.align([a], [b], 1.0, 0)[0]) else ([0], [0], [None], 0)
        top = max(full.values())
        if offset is not None:
            assert full[int(offset)] == top and abs(offset) == min(abs(o) for o, n in full.items() if n == top)


def test_media_recall_on_texts_and_repetitive_recordings(real):
    random = np.random.default_rng(6)
    texts = [r.text.encode() for r in real.where("text is not null").limit(120).collect()]
    texts += [(b"the same line again and again\n" * 60) + bytes(random.integers(97, 123, 500).tolist()) for _ in range(2)] + [b"a" * 6000, b"a" * 3000 + texts[0], b"ab" * 2000]
    texts += [t[64 * k :] for k, t in enumerate(texts[:25])] + [t[: len(t) - 7 * k] for k, t in enumerate(texts[40:60])]
    items = [x for x in (media.integers(np.frombuffer(t, np.uint8)) for t in texts) if len(x)]
    q, r, *_ = media.align(items, items, 0.2, 16)
    found, true = {(int(a), int(b)) for a, b in zip(q, r, strict=True)}, set()
    for a, x in enumerate(items):
        for b, y in enumerate(items):
            for off in range(-len(x) + 16, len(y) - 15):
                s = max(0, -off)
                n = min(len(x), len(y) - off) - s
                if n >= max(16, min(len(x), len(y)) / 2) and np.bitwise_count(x[s : s + n] ^ y[s + off : s + off + n]).sum() / 32 / n <= 0.2:
                    true.add((a, b))
                    break
    assert found <= true and len(found) >= 0.9 * len(true) and sum(a != b for a, b in true) >= 30


def test_media_search_counts_copies(spark):
    random = np.random.default_rng(2)
    a, b = bytes(random.integers(0, 256, 4000).tolist()), bytes(random.integers(0, 256, 4000).tolist())
    rows = [(20, a), (21, a), (40, a[64:]), (41, b), (60, None)]
    found = {r.doc_id: r for r in media.search(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert found[21].recording_id == 20 and found[21].n_aligned == 1 and found[20].best_id == 40 and found[20].best_offset == -1
    assert found[40].n_aligned == 2 and found[41].n_aligned is None and found[60].n_aligned == 0


def test_simhash_equals_brute_force(spark, real):
    def fingerprint(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    found = simhash.near_duplicates(real).withColumn("hex", simhash.fingerprint_hex(F.col("fp"))).collect()
    prints = {r.doc_id: fingerprint(r.text) for r in real.collect()}
    assert all(f"{prints[r.doc_id]:016x}" == r.hex for r in found)
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id: r.component_id for r in found} == {d: root(d) for d in prints}


def test_simhash_walk_in_parts_loses_nothing(spark, monkeypatch):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 60, dtype=np.int64)
    values = np.unique(np.concatenate([base, base ^ np.int64(7), base ^ np.int64(1 << 40)]))
    rows = [(i, [int(v)]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, fp array<long>")
    monkeypatch.setattr(simhash, "TILE", 2)
    links = {tuple(sorted((r.a, r.b))) for r in simhash.trie_links(df, simhash.slices(1, 5), 1, 4, len(rows)).collect()}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for i, v in enumerate(values):
        for j in range(i):
            if (int(v) ^ int(values[j])).bit_count() <= 4:
                assert root(i) == root(j)


def test_credentials_base_spans(docs, real):
    keyword = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def base(text):
        out = [(m.start(), 0, m.end(), "assign") for m in keyword.finditer(text) if len(m[1]) >= 6]
        out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(out))

    for table in (docs, real):
        expected = Counter((r.doc_id, hashlib.sha256(base(r.text or "").encode()).hexdigest()) for r in table.collect())
        assert Counter((r.doc_id, r.base_sha256) for r in credentials.digest(credentials.scan(table)).collect()) == expected


def test_credentials_of_many_owners_are_examples(spark):
    rows = [(i, "password=copied123", f"o{i}") for i in range(5)] + [(9, "password=mine98765 x", "o1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = {r.doc_id: r.text for r in credentials.redact(df).collect()}
    assert cleaned[0] == "password=copied123" and cleaned[9] == "password=[SECRET] x"


def test_credentials_by_owners_and_repositories_equal_brute_force(spark):
    mixed = "Zx9" + "aB3dE5fG7hJ9kL1mN3pQ"
    rows = [(i, f"password=two{'x' * 6} {mixed if i % 9 == 0 else ''}", f"o{i % 2}") for i in range(30)]
    rows += [(100 + i, "token: oneowner77 ghp_abcdefghijklmnop1234", "o1") for i in range(40)] + [(200, "secret=pair4321", "o1"), (201, "secret=pair4321", "o2"), (202, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    owners, repositories = defaultdict(set), defaultdict(set)
    for i, text, owner in rows:
        for *_, value in credentials.candidates(text):
            owners[value].add(owner)
            repositories[value].add(i)
    live = lambda v: len(owners[v]) < 3 and (len(owners[v]) < 2 or len(repositories[v]) < 20)
    expected = {i: ",".join(f"{k}:{a}:{z}" for k, a, z, _, v in credentials.candidates(text) if k in credentials.BASE or live(v)) for i, text, _ in rows}
    found = {r.doc_id: r for r in credentials.digest(credentials.scan(df)).collect()}
    assert {i: r.spans for i, r in found.items()} == expected
    assert found[0].n_live < found[0].n_live + found[0].n_example and found[100].n_example == 0 and found[200].n_live == 1


def test_cascade_order_does_not_change_verdicts(docs):
    rules = quality.BASE_RULES + quality.METHOD_RULES
    forward, backward = (docs.where(quality.first_rejection(F.col("text"), r).isNull()).count() for r in (rules, rules[::-1]))
    assert forward == backward == quality.quality_filter(docs).count()
    planned = quality.plan_cascade(docs, rules=rules)
    assert {r.name for r in planned} == {r.name for r in rules} and all(r.cost > 0 for r in planned)


def test_cascade_orders_by_rejections_among_the_rows_that_are_left():
    rule = lambda name, cost: quality.Rule(name, lambda m: m["n_words"], cost=cost)
    # b rejects most, but nothing that a, which is cheaper, leaves
    rows = {(True, True, False): 40, (False, False, True): 10, (False, False, False): 50}
    order = quality.order_rules([rule("a", 1.0), rule("b", 1.5), rule("c", 2.0)], rows)
    assert [r.name for r in order] == ["a", "c", "b"] and [round(r.rejection, 3) for r in order] == [0.4, round(10 / 60, 3), 0.0]
    assert [r.name for r in quality.order_rules([rule("a", 1.0), rule("b", 0.5)], {})] == ["b", "a"]


def test_license_labels(spark):
    rows = [(1, "Released under the MIT License."), (2, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"), (3, "plain")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].base_labels == "mit" and found[1].first_word == 3 and found[2].labels == "mit" and found[2].base_labels == ""
    assert found[3].labels == "" and found[3].score == 0 and found[3].first_word is None


def test_lm_counts_and_probabilities(spark, real):
    train = real.where("doc_id % 3 <> 0")
    model, counts = lm.train(train, top=100, hot=300, steps=40)
    found = lm.score(real, model, counts).collect()
    c = Counter(w for r in train.collect() for w in words(r.text.lower() if r.text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), r.text)))
    ends = train.count()
    total, types = sum(c.values()) + ends, len(c) + 1
    text = {r.doc_id: r.text for r in real.collect()}
    for r in found:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text[r.doc_id]))
        base = sum(math.log10((n + 0.5) / (total + 0.5 * (types + 1))) for n in [*(c[x] for x in w), ends])
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in w) + 1 and r.train_tokens == total
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert np.allclose((10.0 ** model.pairs.astype(float)).sum(-1), 1, atol=1e-3)
    n = {r["word"]: r["n"] for r in counts.collect()}
    for r in found[:40]:
        classes, want = [0, 0], 0.0
        for w in [*lm.tokens(text[r.doc_id]), None]:
            at, bucket = model.hot.get(w), zlib.crc32(w or b"") % lm.BUCKETS
            cls = 0 if w is None else int(model.classes[at]) if at is not None else model.top + 1 + bucket
            share = 0.0 if w is None else model.within[at] if at is not None else math.log10((n.get(w.decode(), 0) + 0.5) / model.bucket_tokens[bucket])
            want += share + math.log10(sum(s * 10.0 ** float(model.pairs[k, classes[-1 - k], cls]) for k, s in enumerate(lm.SHARES)))
            classes.append(cls)
        assert math.isclose(r.score, want, rel_tol=1e-5)
    held = [r for r in found if r.doc_id % 3 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_queries_return_whole_tables(spark):
    for name in ("op5_media", "op7_secrets"):
        assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
