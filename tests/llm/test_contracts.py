"""Each registered query against brute force, over a whole small table and over odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirelake.llm import (
    bpe,
    decontamination,
    license_scan,
    minhash_dedup,
    pii_semicrf,
    preference_chat,
    quality_cotraining,
    quality_rules,
    queries,
    suffix_tree_lm,
    toxicity_fm,
)

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [
    None, "", " \n\t ", "one", "one two three", "a b c d e f g h i j " * 300, "Ünder the MIT license. UNDER THE MIT LICENSE!", "x\x0by\x1cz\x85w v",
    "mail a.b@c.d.ef, a@b @c.d ip 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 +1 (017) 555-7713 +12", "CC BY-NC 4.0 apache LICENSE, version 2.0",
    "9" * 5000, "a" * 30000, "<|endoftext|>hi <|startoftext|>", "same text here twice", "same text here twice", "l1\nl2\nl1\n\n \nl1\n",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, repeated rows, and extra columns whose names clash with results."""
    rows = [(i, t, "x", True, 1.0) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None), (13, "same text here twice", "x", True, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, labels string, kept boolean, score double")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def both(spark, odd, docs):
    return {"odd": odd, "docs": docs}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted((tuple(r[n] for n in ("doc_id", *names)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_bpe(both, which):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    want = []
    for i, text in pairs(both[which]):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert rows(bpe.bpe_digests(both[which], path), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_round_trip(odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    got = rows(bpe.bpe_decode(bpe.bpe_encode(odd, path), path), "text")
    want = [(i, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in pairs(odd)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_license_base(both, which):
    want = []
    for i, text in pairs(both[which]):
        words = ALNUM_WORD.findall(low(text))
        at, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = license_scan.license_scan(both[which]).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, same_as_duckdb, name):
    same_as_duckdb(queries.queries()[name](spark, small), queries.oracle_sql()[name], small)


def test_license_templates(spark):
    text = "Some text. " * 30 + license_scan.TEMPLATES["bsd"][0].upper().replace(" FORMS ", " ") + " more" * 50
    df = spark.createDataFrame([(1, text), (2, "license binary source redistribution")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(df).collect()}
    assert got[1][0] == "bsd" and 0.9 <= got[1][1] < 1 and got[2] == ("", 0.0)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality_rules(both, which):
    want = []
    for i, text in pairs(both[which]):
        text = text or ""
        words = SPACE_WORD.findall(text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACE_WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = len(words)
        want.append((i, n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n))
    entries = quality_rules.apply_policy(quality_rules.ledger(both[which]))
    assert rows(entries, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not entries.where("base_failed and kept").count()


@pytest.mark.parametrize("policy", sorted(quality_rules.POLICIES))
def test_quality_ablation(docs, policy):
    bits = quality_rules.POLICIES[policy]
    entries = quality_rules.ledger(docs)
    masks = [r["failed"] & bits for r in entries.collect()]
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(entries, policy).collect()}
    assert got == {r.name: (sum(m >> r.bit & 1 for m in masks), sum(m == 1 << r.bit for m in masks)) for r in quality_rules.RULES if bits >> r.bit & 1}


def shingle_sets(df, width):
    out = {}
    for i, text in pairs(df):
        words = SPACE_WORD.findall(low(text))
        w = min(width, len(words))
        out[i] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)} if words else set()
    return out


def brute_components(sets):
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("which", ["odd", "docs", "chains"])
def test_minhash(spark, both, which):
    if which == "chains":  # near copies in chains and stars, and a hot group of copies
        base = [f"w{i}" for i in range(60)]
        texts = [" ".join(base[:k] + [f"x{k}"] + base[k:]) for k in range(0, 60, 2)]
        texts += [" ".join(f"c{j}" for j in range(s, s + 100)) for s in range(0, 60, 8)] + ["hot copy of five words"] * 40
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    else:
        df = both[which]
    sets = shingle_sets(df, 4)
    want = brute_components(sets)
    for r in minhash_dedup.near_duplicates(df, width=4).collect():
        i = r["doc_id"]
        assert r["n_shingles"] == len(sets[i])
        assert r["component_id"] == (None if i is None else want[i]) and r["kept"] == (i is None or want[i] == i)


def test_minhash_keeps_links(spark):
    """A stranger that shares buckets with two similar texts does not undo their link."""
    c = [f"c962x{i}" for i in range(39)]
    texts = ["a962y0 a962y1 " + " ".join(c) + " a962z0 a962z1", "b962y0 b962y1 " + " ".join(c) + " b962z0 b962z1", " ".join(c[2:36])]
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute_components(shingle_sets(df, 4))
    assert want[2] == 1
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, width=4).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_minhash_random(spark, seed):
    """Families of texts edited at random, about the threshold, among shared passages."""
    import random

    rng = random.Random(seed)
    texts = []
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"x{rng.random()}"]
            if rng.random() < 0.3:
                words += ["a", "passage", "that", "many", "texts", "share"] * 2
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(shingle_sets(df, 4))
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(df, width=4).collect()} == want


def test_minhash_compares_few_pages_of_a_template(spark):
    """Pages that share most of their words, but not enough, are not paired with each other."""
    import random

    from pyspark.sql import functions as F

    rng, template = random.Random(5), [f"t{i}" for i in range(88)]
    for own, most in ((22, 0), (15, 0), (12, 60)):  # about 0.68, 0.77 and 0.79 of similarity
        rows_ = []
        for i in range(300):
            at = rng.randrange(88)
            rows_.append((i, " ".join(template[:at] + [f"d{i}x{j}" for j in range(own + rng.randrange(-1, 2))] + template[at:])))
        df = spark.createDataFrame(rows_, "node long, text string")
        labels = df.select("node", F.col("node").alias("label"))
        assert minhash_dedup._prefix_pairs(df, labels, 4).count() <= most * len(rows_)
        docs = df.withColumnRenamed("node", "doc_id")
        assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, width=4).collect()} == brute_components(shingle_sets(docs, 4))


def test_intervals_meet_sizes_once(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    starts = [rng.randrange(1, 400) for _ in range(80)]
    intervals = [(a, a + rng.randrange(0, max(1, a // 2))) for a in starts]
    x = spark.createDataFrame(intervals, "low long, high long").select("low", "high", F.inline(minhash_dedup._dyadic(F.col("low"), F.col("high"))))
    sizes = spark.range(1, 700).select(F.col("id").alias("size"), F.inline(minhash_dedup._ancestors(F.col("id"))))
    met = Counter((r["low"], r["high"], r["size"]) for r in x.join(sizes, ["level", "at"]).collect())
    assert met == Counter((a, b, s) for a, b in intervals for s in range(a, b + 1))


def test_keep_one_odd(spark, odd):
    """Null ids, repeated rows and clashing columns; the columns stay."""
    df = odd.withColumnsRenamed({"labels": "gone", "score": "node"})
    made = minhash_dedup.keep_one(df, width=4)
    assert made.columns == df.columns
    sets = shingle_sets(df, 4)
    want = brute_components(sets)
    assert sorted(pairs(made), key=repr) == sorted(((i, t) for i, t in pairs(df) if i is None or want[i] == i), key=repr)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffix_tree(both, which):
    data = pairs(both[which])
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*SPACE_WORD.findall(low(t)), "\n"]
    c = Counter(w for i, t in data if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = sorted(suffix_tree_lm.language_scores(both[which]).collect(), key=repr)
    assert len(got) == len(data)
    by_id = defaultdict(list)
    for i, t in data:
        by_id[i].append(t)
    for r in got:
        ts = tokens(by_id[r["doc_id"]][0])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(ts), sum(c[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_suffix_tree_is_a_distribution():
    import numpy as np

    texts = [b"abracadabra abra"] * 30 + [b"the cat sat"] * 30
    packed, starts = suffix_tree_lm.grams(texts)
    levels = []
    for d in range(suffix_tree_lm.DEPTH + 1):
        keys, counts = np.unique(packed & suffix_tree_lm._MASK[d + 1], return_counts=True)
        levels.append((keys, counts))
    tree = suffix_tree_lm.SuffixTree.grown(levels)
    assert any(len(s[0]) for s in tree.states)
    for context in {int(p) >> 8 for p in packed[:40]} | {12345}:
        total = np.exp(tree.log_p(np.array([context << 8 | s for s in range(256)], np.int64))).sum()
        assert total == pytest.approx(1)
    assert len(starts) == 60 and tree.scores([b"abracadabra"])[0] > tree.scores([b"bdarcaaabra"])[0]


def test_suffix_tree_keeps_rare_contexts(spark):
    """Sixty occurrences make a state also among many million symbols."""
    docs = spark.createDataFrame([(i, "a b c d e f g h " * 30_000) for i in range(40)] + [(i, "zyxwvutsrqp") for i in range(100, 160)], "doc_id long, text string")
    score = suffix_tree_lm.language_scores(docs).where("doc_id = 101").first()["score"]
    assert score > -12


def test_suffix_tree_parts(docs, monkeypatch):
    """A tree that is scored in parts gives the scores of the whole tree."""
    want = {r["doc_id"]: r["score"] for r in suffix_tree_lm.language_scores(docs).collect()}
    monkeypatch.setattr(suffix_tree_lm, "PART_ROWS", 3_000)
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.language_scores(docs).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_pii_base(both, which):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m)
    keep = {
        "email": (email, lambda m: True),
        "ip": (ip, lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (card, lambda m: 13 <= len(digits(m)) <= 19 and pii_semicrf.luhn(digits(m))),
        "phone": (phone, lambda m: 9 <= len(digits(m)) <= 15),
    }
    want = []
    for i, text in pairs(both[which]):
        if text and len(text) > 20000:
            text = ""
        spans = [(k, *m.span()) for k, (p, ok) in keep.items() for m in p.finditer(text or "") if ok(m[0])]
        counts = Counter(s[0] for s in spans)
        want.append((i, *(counts[k] for k in keep), sha(",".join(f"{k}:{b}:{e}" for k, b, e in spans))))
    got = pii_semicrf.personal_data(both[which])
    assert rows(got, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_pii_more(spark):
    texts = ["call (743) 555-3824 now", "id 123-45-6789 here", "on 2024-01-02, 12/11/2020, 3.14, 1990-1995, 9807915762804491", "bob [at] mail [dot] com", "192.168.10.20 4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_semicrf.personal_data(df).collect()}
    assert got == {0: "phone:5:19", 1: "id:3:14", 2: "", 3: "email:0:23", 4: "ip:0:13,card:14:30"}
    assert [r["text"] for r in pii_semicrf.redact(df).orderBy("doc_id").collect()][0] == "call <PHONE> now"


def test_quality_of_several_texts_does_not_depend_on_their_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    more = docs.withColumn("text", F.concat(F.lit("other words "), "text")).unionByName(docs)
    rounded = lambda r: (r["doc_id"], *(round(r[c], 9) for c in ("text_score", "metadata_score", "score")), r["kept"])
    once = {rounded(r) for r in quality_cotraining.quality_scores(more.orderBy("doc_id", "text").coalesce(1), labels).collect()}
    again = {rounded(r) for r in quality_cotraining.quality_scores(more.orderBy(F.desc("text")).repartition(7), labels).collect()}
    assert once == again


def test_pii_leaves_decimals_alone():
    import random

    rng = random.Random(1)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    field = pii_semicrf.trained()
    for a in range(1, 4):
        for b in range(1, 16):
            for form in ("is {x} ok", "{x}, {y}", "({x})", "{x} {y} kg", "-{x}%", "{x}-{y}", "phone {x}", "id: {x}"):
                for point in ".,":
                    text = form.format(x=f"{d(a)}{point}{d(b)}", y=f"{d(a)}{point}{d(b)}")
                    base, found = pii_semicrf.find(text, field)
                    assert found == base, text


def test_pii_kinds_of_four_languages(spark):
    texts = {
        "01 23 45 67 89": "phone:0:14", "call 030 12345678 now": "phone:5:17", "912 345 678": "phone:0:11", "x 123 45 6789.": "id:2:13", '"token" = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" From': "secret:11:51",
        "Herr Karl Müller kam": "name:5:16", "pi is 3.1415926535 exactly": "", "1.234.567, version 10.15.7 and 2024-01-02 10:11:12": "", "look (at) this.thing now": "", "key to the city, password reset": "", "jo.x(at)mail.example.org": "email:0:24",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii_semicrf.personal_data(df).collect()} == dict(enumerate(texts.values()))
    assert [r["text"] for r in pii_semicrf.redact(df).orderBy("doc_id").collect()][6:9] == list(texts)[6:9]


def test_pii_precision_and_recall():
    """On generated texts that the field has not seen."""
    field, right, found_, wanted = pii_semicrf.trained(), 0, 0, 0
    for text, spans in pii_semicrf.generated(1500, seed=99):
        base, found = pii_semicrf.find(text, field)
        right += len(set(found) & set(spans))
        found_ += len(set(found) - (set(base) - set(spans)))
        wanted += len(spans)
    assert right / found_ > 0.98 and right / wanted > 0.95


def test_pii_field_by_brute_force():
    """The best segmentation and the sum over all of them, against every segmentation of short sequences."""
    import random

    rng = random.Random(4)
    field = pii_semicrf.trained()

    def every(lattice, j):
        if j == 0:
            return [(0.0, [])]
        return [(score + field._score(kind, found), [*path, (i, kind, j)]) for i, kind, found in lattice[j - 1] for score, path in every(lattice, i)]

    for _ in range(60):
        text = "".join(rng.choice(["+", " ", "-", ".", "(", ") "]) + "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 8)))
        for s in pii_semicrf.sequences(text):
            lattice = list(field._lattice(text, s))
            scored = every(lattice, len(s.atoms))
            best = max(scored, key=lambda t: t[0])
            spans = [(k, *pii_semicrf.segment(text, s, i, j - 1)) for i, k, j in best[1] if k]
            assert field.best(text, s) == spans
            total = max(x for x, _ in scored)
            assert field.expectation(lattice, Counter()) == pytest.approx(total + math.log(sum(math.exp(x - total) for x, _ in scored)))


def test_preference_odd(spark):
    rows_ = [(1, s, t, "user" if t % 2 == 0 else "assistant", x) for s, xs in (("chosen", ["q", "a", "q2", None]), ("rejected", ["q", "a", "q2", "no"])) for t, x in enumerate(xs)]
    rows_ += [(2, "chosen", 0, None, "x"), (2, "rejected", 0, None, "x"), (None, "chosen", 0, "user", "x"), (3, "chosen", 0, "user", "x"), (3, "chosen", 0, "user", "x")]
    rows_ += [(4, "chosen", 0, "assistant", "é"), (4, "chosen", 0, "assistant", "b"), (4, "other", 0, "user", "x")]
    df = spark.createDataFrame(rows_, "pair_id long, side string, turn long, role string, text string")
    got = sorted((tuple(r) for r in preference_chat.preference_pairs(df).collect()), key=repr)
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    no = (None, None, None, None)
    want = [
        (1, 0, "prompt", turn("user", "q"), *no), (1, 1, "prompt", turn("assistant", "a"), *no), (1, 2, "prompt", turn("user", "q2"), *no),
        (1, 3, "completion", None, turn("assistant", ""), turn("assistant", "no"), "22:32", "22:34"),
        (2, 0, "prompt", turn("unknown", "x"), *no), (3, 0, "completion", None, turn("user", "x") * 2, "", "", ""),
        (4, 0, "completion", None, turn("assistant", "b") + turn("assistant", "é"), "", "22:33,56:67", ""),
    ]
    assert got == sorted(want, key=repr)


def brute_contamination(data, items, window=13):
    owners = defaultdict(set)
    for i, t in items:
        words = ALNUM_WORD.findall(low(t))
        w = min(window, len(words))
        for k in range(len(words) - w + 1) if w else ():
            owners[tuple(words[k : k + w])].add(i)
    widths = {len(o) for o in owners}
    out = []
    for i, t in data:
        words = ALNUM_WORD.findall(low(t))
        hit, found = set(), set()
        for w in widths:
            for k in range(len(words) - w + 1):
                if (o := owners.get(tuple(words[k : k + w]))) is not None:
                    hit |= set(range(k, k + w))
                    found |= o
        found -= {None}
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 100])
def test_decontamination(spark, small, both, which, most):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(900, "Same text HERE"), (901, "one"), (902, None), (903, ""), (None, "two three"), (904, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(both[which], benchmark, most=most)
    assert rows(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(pairs(both[which]), items)


def test_decontamination_removes(spark, odd):
    benchmark = spark.createDataFrame([(1, "same text here twice")], "item_id long, text string")
    assert decontamination.decontaminate(odd, benchmark).count() == odd.count() - 3
    left = decontamination.decontaminate(odd, benchmark, remove="spans")
    assert left.columns == odd.columns and left.where("text = ''").count() == 1 + 3


@pytest.mark.parametrize("most", [8, 100, decontamination.MOST_WINDOWS])
@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontamination_blocks(spark, odd, most, remove):
    """However the benchmark is cut: rows with null ids, two texts of one id, overlapping windows."""
    words = [f"w{i}" for i in range(40)]
    rows_ = [(None, " ".join(words)), (50, "clean text of that id"), (50, " ".join(words[:20])), (51, "Intro, " + ", ".join(words[5:30]) + "! Outro."), (51, "Intro, " + ", ".join(words[5:30]) + "! Outro.")]
    extra = spark.createDataFrame([(i, t, "x", True, 1.0) for i, t in rows_], odd.schema)
    docs = odd.unionByName(extra).withColumnsRenamed({"labels": "key", "score": "bad"})
    benchmark = spark.createDataFrame([(1, " ".join(words[:25])), (2, " ".join(words[10:])), (3, "same text here twice")], "item_id long, text string")
    got = sorted(pairs(decontamination.decontaminate(docs, benchmark, remove=remove, most=most)), key=repr)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    if remove == "documents":
        want = [(i, t) for i, t in pairs(docs) if not brute_contamination([(i, t)], items)[0][-1]]
    else:
        cut = {" ".join(words): "", " ".join(words[:20]): "", "same text here twice": "", rows_[3][1]: "Intro, ! Outro."}
        want = [(i, cut.get(t, t)) for i, t in pairs(docs)]
    assert got == sorted(want, key=repr)


def test_quality_draws_from_the_rest(spark, monkeypatch):
    """New rows are handed over in every round."""
    import random

    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["###", "$$$", "plain", "words", "line", "of", "text", "5%"]) for _ in range(rng.randrange(5, 60)))
    docs = spark.createDataFrame([(i, text(), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "d"]), rng.randrange(10, 9000)) for i in range(3_000)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(rng.random() < 0.6)) for i in range(300)], "doc_id long, quality int")
    left, histograms = [], quality_cotraining.Pool.histograms

    def counted(self, views, rules):
        found = histograms(self, views, rules)
        left.append([int(n.sum()) for _, n in found])
        return found

    monkeypatch.setattr(quality_cotraining.Pool, "histograms", counted)
    quality_cotraining.quality_scores(docs, labels)
    assert len(left) == quality_cotraining.ROUNDS
    assert all(b < a for view in (0, 1) for a, b in itertools.pairwise(x[view] for x in left))


def held_out_scores(spark, query, label):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in query(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    return [(r["score"], labels[r["doc_id"]]) for r in got]


def test_toxicity_accuracy(spark):
    scores = held_out_scores(spark, queries.op10_toxicity, "toxic")
    hit = sum(s >= 0.5 and y for s, y in scores)
    assert hit >= 0.95 * sum(s >= 0.5 for s, _ in scores) and hit >= 0.8 * sum(y for _, y in scores)


def test_quality_accuracy(spark):
    scores = held_out_scores(spark, queries.op1_quality, "quality")
    assert sum((s >= 0.5) == bool(y) for s, y in scores) >= 0.95 * len(scores)


def test_quality_pool_is_whole(spark):
    """A source that is rare and unlabelled, beyond the first thousands of rows by the hash, gets pseudo-labels."""
    from pyspark.sql import functions as F

    rows = spark.range(20_000).withColumn("good", F.col("id") % 10 != 0)
    order = [r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").select("id").collect()]
    rare = [i for i in order[-8_000:] if i % 10 == 0][:200]
    docs = rows.select(
        F.col("id").alias("doc_id"), F.when(F.col("good"), F.concat(F.lit("Plain words make a fine line of text about topic "), F.col("id"), F.lit("."))).otherwise("### $$$ %%% buy buy buy buy buy !!!").alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id").isin(rare), "rare").when(F.col("good"), "fine").otherwise("spam").alias("source"), F.lit(50).cast("long").alias("n_chars"),
    )
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in order[:1_000]], "doc_id long, quality int")
    scores = {r["source"]: r["m"] for r in quality_cotraining.quality_scores(docs, labels).join(docs, "doc_id").groupBy("source").agg(F.avg("metadata_score").alias("m")).collect()}
    assert scores["rare"] < 0.5 * scores["fine"]


@pytest.mark.parametrize("fit", [toxicity_fm.toxicity_scores, quality_cotraining.quality_scores])
def test_classifiers_odd(spark, odd, fit):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (3, 1, 0)], none.schema)
    for labels in (none, some):
        got = fit(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_learns_from_whole_texts(spark):
    """A toxic word beyond thousands of words of smaller crc32 is learned."""
    toxic = next(w for i in itertools.count() if zlib.crc32((w := f"zz{i}").encode()) > 0xFFF00000)
    filler = " ".join(f"word{i}" for i in range(3_000))
    docs = spark.createDataFrame([(i, f"{filler} {toxic}" if i % 2 else filler) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    assert {(r["doc_id"] % 2, r["predicted"]) for r in toxicity_fm.toxicity_scores(docs, labels).collect()} == {(0, 0), (1, 1)}


def test_interaction_of_terms():
    """An insult and a group mention are toxic together only: the pairwise part has to tell."""
    import numpy as np

    words = {"insult": [1, 2], "group": [3, 4], "plain": [5, 6]}
    data = [(words["insult"] + words["plain"], 0), (words["group"] + words["plain"], 0), (words["insult"] + words["group"], 1), (words["plain"], 0)] * 60
    m = toxicity_fm.FactorizationMachine.fitted([np.array(d) for d, _ in data], np.array([y for _, y in data], float))
    score = lambda terms: m.bias + sum(m.weights[i := [m.place[t] for t in terms if t in m.place]]) + 0.5 * ((m.factors[i].sum(0) ** 2).sum() - (m.factors[i] ** 2).sum())
    assert score(words["insult"] + words["group"]) > 0 > max(score(words["insult"]), score(words["group"]))


def test_interaction_of_weak_terms():
    """Two terms that hardly differ from the average each, but are toxic together, among many others."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 6_000
    a, b = rng.random((2, n)) < 0.17
    others = [np.flatnonzero(rng.random(400) < 0.1) + 100 for _ in range(n)]
    labels = (rng.random(n) < np.where(a & b, 0.75, np.where(a | b, 0.01, 0.12))).astype(np.float32)
    for x in (a, b):
        assert abs(labels[x].mean() - labels.mean()) * np.sqrt(x.sum() / labels.mean() / (1 - labels.mean())) < 5
    m = toxicity_fm.FactorizationMachine.fitted([np.append(o, [t for t, x in ((1, a[i]), (2, b[i])) if x]).astype(np.int32) for i, o in enumerate(others)], labels)

    def score(*terms):
        i = [m.place[t] for t in terms if t in m.place]
        return m.bias + m.weights[i].sum() + 0.5 * ((m.factors[i].sum(0) ** 2).sum() - (m.factors[i] ** 2).sum())

    assert score(1, 2) > 0 > max(score(1), score(2), score())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    made = [
        quality_cotraining.quality_scores(docs, labels), bpe.bpe_digests(docs, queries.tokenizer_path()), license_scan.license_scan(docs), quality_rules.ledger(docs),
        minhash_dedup.near_duplicates(docs), suffix_tree_lm.language_scores(docs), pii_semicrf.personal_data(docs),
        preference_chat.preference_pairs(preference_chat.swapped_answers(turns)), decontamination.contamination(docs, benchmark), toxicity_fm.toxicity_scores(docs, labels),
    ]
    assert [df.count() for df in made] == [0] * 10
