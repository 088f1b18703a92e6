"""Operators that SQL cannot express, against plain versions: scores, packings, alignments, spans, tags and the pipeline."""

import itertools
import math
import random
import re

import numpy as np
from test_jaccard import brute, edited

import corpus_pipeline
from folioframe.llm import line_dedup, packing, secret_scan, toxicity

KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain_spans(text):
    """Base spans by walking over the text, without patterns."""

    def assign(i):
        for key in KEYS:
            p = i + len(key)
            part = text[i:p]
            if not (part.isascii() and part.lower() == key):
                continue
            p += text[p : p + 1] in ("'", '"')
            while text[p : p + 1] == " ":
                p += 1
            if text[p : p + 1] not in (":", "="):
                continue
            p += 1
            while text[p : p + 1] == " ":
                p += 1
            p += text[p : p + 1] in ("'", '"')
            end = p
            while end < len(text) and text[end] in VALUE:
                end += 1
            if end > p:
                return end, end - p >= 6
        return None

    def run(i, head, chars, least):
        end = i + len(head)
        if not text.startswith(head, i):
            return None
        while end < len(text) and text[end] in chars:
            end += 1
        return (end, end - i >= least) if end > i + len(head) else None

    found = []
    kinds = (assign, lambda i: run(i, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), lambda i: run(i, "", set("0123456789abcdef"), 24))
    for k, match in enumerate(kinds):
        i = 0
        while i < len(text):
            got = match(i)
            if got and got[1]:
                found.append((i, got[0], secret_scan.KINDS[k]))
            i = got[0] if got else i + 1
    return sorted(found, key=lambda x: (x[0], secret_scan.KINDS.index(x[2])))


def test_base_spans(spark):
    rng = random.Random(12)
    parts = ["token", "SECRET", "api_key", "apikey", "passwd", "Password", "toKen", "paſſword", "=", ":", " ", "'", '"', "abc", "abcdef", "AKIA", "AKIAB3", "0123456789abcdef", "deadbeef", "é", "\n", "=x", "A1B2C3D4E5F6G7H8"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    assert all(secret_scan.base_spans(t) == plain_spans(t) for t in texts)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: plain_spans(r["text"] or "") for r in docs.collect()}
    from folioframe.llm.registry import queries

    for r in queries()["op10_secret_scan"](spark, "/root/testdata/sf0.001").collect():
        own = want[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, _, k in own) for n in ("assign", "access", "hex")]
        assert r["base_sha256"] == secret_scan.brute_force_sha(own)
        assert {f"{k}:{a}:{b}" for a, b, k in own} <= set(r["spans"].split(","))


def test_field_adds_beyond_base_spans():
    """A tagged word that goes beyond a pattern's span is added whole; one inside it is not."""
    field = secret_scan.train([(*secret_scan._tagged(t, s), i % 3) for i, (t, s) in enumerate(secret_scan._generated(7, 1500))])
    text = "set password=hunter22!Zq9#xY7$w now"
    raw = (text + "\n").encode()
    got = secret_scan.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), secret_scan.Tagger(field))[0]
    base = [s for s in got if s[2] != "crf"]
    assert base == plain_spans(text) == [(4, 21, "assign")]
    assert all(not any(a <= s[0] and s[1] <= b for a, b, _ in base) for s in got if s[2] == "crf")


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, t = int(rng.integers(1, 6)), rng.normal(size=(3, 3))
        e, before, after = rng.normal(size=(n, 3)), rng.choice([None, 0]), rng.choice([None, 0])

        def value(path):
            whole = ([before] if before is not None else []) + list(path) + ([after] if after is not None else [])
            return sum(e[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(whole, whole[1:], strict=False))

        best = max(itertools.product(range(3), repeat=n), key=value)
        assert math.isclose(value(secret_scan.viterbi(e, t, before, after)), value(best))


def test_toxicity_scores(spark):
    """Scores from the model by hand: all segments of each text, the significant ones by the definition, the link."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(80)] + ["bad", "worse", "vile"] * (3 if i % 4 == 0 else 0), k=rng.randint(0, 60)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(toxicity.labelled_rows(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")))
    got = {r["doc_id"]: (r["score"], len(r["passages"])) for r in toxicity.score_toxicity(docs, model).collect()}
    lam, weights = float(model.lam[0]), model.weights[0]
    for i, text in rows:
        raw = (text.lower() + "\n").encode()
        score = weights[toxicity._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]].astype(float)
        n = len(score)
        sums = np.append(0, np.cumsum(score))
        chance = model.log_k + math.log(max(1, n))
        # A maximal segment has no proper part of at least its score and lies in no larger such segment.
        good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(sums[a] < sums[k] for k in range(a + 1, b + 1)) and all(sums[b] > sums[k] for k in range(a, b))]
        whole = [(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)]
        nats = [lam * (sums[b] - sums[a]) - chance for a, b in whole]
        sure = [x for x in nats if x >= toxicity.SIGNIFICANT]
        want = toxicity._chance(model.link, toxicity._features(max(nats, default=-chance), math.log1p(sum(sure)) if sure else 0.0, n))
        assert math.isclose(got[i][0], want, rel_tol=1e-5, abs_tol=1e-7) and got[i][1] == len(sure)


def plain_bins(pieces, sizes, least):
    """Contents of the bins of best-fit decreasing, piece by piece."""
    bins = []
    for x in sorted(pieces, reverse=True):
        fits = [b for b in bins if b[0] >= x]
        if fits:
            at = min(fits, key=lambda b: b[0])
            at[0] -= x
            at[1] += x
        else:
            size = next(c for c in sizes if c >= max(x, least) or c == sizes[-1])
            bins.append([size - x, x])
    return sorted(b[1] for b in bins)


def test_packing_against_plain_and_best():
    rng = random.Random(8)
    sizes = (8, 16, 32)

    def cost(bins):
        return sum(next(c for c in sizes if c >= held) + 2 for held in bins)

    def best(pieces):
        found = [math.inf]

        def put(i, bins):
            if i == len(pieces):
                found[0] = min(found[0], cost(bins))
                return
            for k in range(len(bins)):
                if bins[k] + pieces[i] <= sizes[-1]:
                    put(i + 1, [*bins[:k], bins[k] + pieces[i], *bins[k + 1 :]])
            put(i + 1, [*bins, pieces[i]])

        put(0, [])
        return found[0]

    worst = 1.0
    for _ in range(150):
        pieces = [rng.randint(1, 32) for _ in range(rng.randint(1, 7))]
        histogram = {x: pieces.count(x) for x in pieces}
        got, ranges, bins = packing.cheapest_plan(histogram, sizes, 2)
        assert sum(n for _, _, n, _ in ranges) == len(pieces) and sum(n * held for _, n, held, _ in bins) == sum(pieces)
        assert got == min(cost(plain_bins(pieces, sizes, least)) for least in sizes)
        worst = max(worst, got / best(pieces))
        assert got >= best(pieces)
    assert worst <= 1.35


def test_patience_of_unique_lines_is_longest():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.sample(range(14), rng.randint(0, 12)) for _ in range(2))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            longest[i + 1][j + 1] = longest[i][j] + 1 if a[i] == b[j] else max(longest[i][j + 1], longest[i + 1][j])
        assert len(line_dedup.patience(a, b)) == longest[-1][-1]


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Each stage on a small folder: toxic documents, repeated blocks, near copies and leaks go, all else stays, all tokens are packed."""
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    item, block = prose(25), "this line of a licence stands in many of the texts\nand so does this second line of it"
    texts = [prose(120) for _ in range(150)]
    for i in range(0, 150, 5):
        texts[i] = " ".join(texts[i].split()[:60] + rng.choices(["vile", "worse", "hateful", "slur"], k=12) + texts[i].split()[60:])
    for i in range(1, 150, 10):
        texts[i] += "\n" + block + f"\n{prose(10)}"
    for i in range(2, 150, 30):
        texts[i + 1] = " ".join(edited(rng, texts[i].split(), 1))
    for i in range(4, 150, 25):
        texts[i] = prose(40) + " " + item + " " + prose(40)
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)] + [(150, "", "en", "src", 0), (151, None, "en", "src", None), (152, texts[2], "de", "x", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, now, made = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r[1] for r in rows}, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        if name == "toxicity":
            now = {d: t for d, t in now.items() if d % 5 or d >= 150}
        elif name == "line dedup":
            kept, before = {}, []
            for d, t in now.items():
                lines = t.split("\n") if t else []
                gone = set(range(len(lines))) if lines in before and lines else set()
                for earlier in before:
                    gone |= set(line_dedup.blocks(lines, earlier, [len(x) for x in lines], line_dedup.MIN_BLOCK))
                before.append(lines)
                left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
                if left or not t:
                    kept[d] = t if not t else left
            now = kept
        elif name == "n-gram Jaccard join":
            class_of = brute([(d, t) for d, t in now.items() if t])
            now = {d: t for d, t in now.items() if not t or class_of[d][0] == d}
        elif name == "benchmark decontamination":
            now = {d: t for d, t in now.items() if not t or item not in t}
        else:
            tokens = {}
            for r in out.collect():
                tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["n_tokens"]
            encode = packing.load_encoding().encode_ordinary
            assert tokens == {d: len(encode(t)) for d, t in now.items() if t}
            break
        assert {r["doc_id"]: r["text"] for r in out.collect()} == now, name
        assert out.columns == docs.columns
        docs, made = out, [*made, len(now)]
    assert made == sorted(made, reverse=True) and len(set(made)) == 4
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == sorted(d for d, t in now.items() if t)
    assert not re.search("slur|vile", " ".join(t for t in now.values() if t))
