"""The pipeline against plain Python, stage by stage."""

import math
import zlib

import numpy as np
from brute import base_statistics, cut_windows, exact, near
from test_operators import check_pieces

import corpus_pipeline
from loamtree.llm.quality_rules import CUTOFF, FEATURES, LAST_STEPS, PRIOR, SHARE, SPREAD, STARTS, STEPS, SUBSET, quality_rules


def rank(values, share):
    return np.sort(values)[max(0, math.ceil(share * len(values)) - 1)]


def verdicts(docs: dict) -> dict[int, bool]:
    """docs: id to (text, lang, source). The robust estimates in NumPy, group by group."""
    base = {i: base_statistics(t) for i, (t, _, _) in docs.items()}
    x = {}
    for i, s in base.items():
        words, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
        upper = sum("A" <= c <= "Z" for c in docs[i][0] or "")
        x[i] = np.array([math.log1p(s["n_words"]), s["word_chars"] / words, math.log1p(100 * s["n_symbols"] / chars), math.log1p(s["n_dup_lines"]), math.log1p(100 * s["n_repeat_words"] / words), math.log1p(100 * upper / chars)])
    groups = {}
    for i, (_, lang, source) in docs.items():
        groups.setdefault((lang or "", source or ""), []).append(i)
    floors = np.array(list(FEATURES.values()))
    points = {g: np.array([x[i] for i in ids]) for g, ids in groups.items()}
    far = lambda p, e: np.einsum("ni,ij,nj->n", p - e[0], e[1], p - e[0])
    matrix = lambda cov: SPREAD * cov + np.diag(floors**2)
    moments = lambda rows: (rows.mean(0), np.linalg.inv(matrix(np.cov(rows.T, bias=True))))

    def concentrate(p, estimate):
        d2 = far(p, estimate)
        return p[d2 <= rank(d2, SHARE) * (1 + 1e-12)]

    near_rows, estimate = {}, {}
    for g, p in points.items():
        low, middle, high = (np.array([rank(p[:, k], q) for k in range(6)]) for q in (0.25, 0.5, 0.75))
        starts = [(middle, np.diag(1 / np.maximum((high - low) / 1.349, floors) ** 2))]
        for k in range(1, STARTS + 1):
            drawn = [x[i] for i in groups[g] if zlib.crc32(f"{k}:{i}".encode()) % math.ceil(len(p) / SUBSET) == 0]
            starts += [moments(np.array(drawn))] if drawn else []
        tried = []
        for e in starts:
            before = math.inf
            for _ in range(STEPS):
                rows = concentrate(p, e)
                after = np.linalg.slogdet(matrix(np.cov(rows.T, bias=True)))[1]
                assert after <= before + 1e-9
                e, before = moments(rows), after
            tried.append((before, len(tried), e))
        e = min(tried, key=lambda t: t[:2])[2]
        for _ in range(LAST_STEPS):
            rows = concentrate(p, e)
            e = moments(rows)
        near_rows[g] = rows
    for g, p in near_rows.items():
        wide = np.concatenate([q for h, q in near_rows.items() if h[0] == g[0]])
        own = len(p) / (len(p) + PRIOR)
        cov = own * np.cov(p.T, bias=True) + (1 - own) * np.cov(wide.T, bias=True)
        estimate[g] = own * p.mean(0) + (1 - own) * wide.mean(0), np.linalg.inv(matrix(cov))
    out = {}
    for g, ids in groups.items():
        for i, d2 in zip(ids, far(points[g], estimate[g])):
            out[i] = not base[i]["base_failed"] and d2 <= CUTOFF
    return out


def test_quality_verdicts(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in frame.collect()}
    assert {r.doc_id: r.kept for r in quality_rules(frame).collect()} == {i: bool(k) for i, k in verdicts(docs).items()}


def test_pipeline(spark, sf_dir):
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    keep = verdicts(docs)
    texts = {i: t for i, (t, _, _) in docs.items() if keep[i]}
    texts = {i: texts[i] for i, r in exact(texts).items() if r[2]}
    texts = {i: texts[i] for i, r in near(texts).items() if r[2]}
    texts = {i: kept if gone else texts[i] for i, (_, gone, kept) in cut_windows(texts).items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "substring dedup", "packing"]
    assert check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), texts) > 0.9
