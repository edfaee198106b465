"""The pipeline's stages, one after the other, against brute force; odd rows and an empty table go through."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from loomline.llm import language_id, mixing  # noqa: E402
from loomline.llm.common import materialise  # noqa: E402
from test_operators import brute_language, components, fingerprint, token_ids  # noqa: E402


@pytest.mark.parametrize("name", ["documents", "odd", "none"])
def test_stages(name, request, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if name == "documents" else request.getfixturevalue(name)
    columns = docs.columns
    for at, (stage, f) in enumerate(corpus_pipeline.STAGES):
        given, rows = docs, docs.collect()
        before = [(r.doc_id, r.text or "") for r in rows]
        docs = materialise(f(spark, docs, sf), stage)
        after = docs.collect()
        if at < 4:
            assert docs.columns == columns
            own = Counter((r.doc_id, r.text or "") for r in after)
        if stage == "language_id":
            judged = brute_language([(r.doc_id, r.text or "", r.source, r.text) for r in rows], [r.lang for r in rows]) if rows else []
            assert own == Counter((r.doc_id, r.text or "") for r, (n, _) in zip(rows, judged, strict=True) if n != "und")
        if stage == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            assert Counter(norm(t) for _, t in own.elements()) == Counter({norm(t) for _, t in before})
        if stage == "near_dedup":
            assert own.total() == len(set(components([fingerprint(t) for _, t in before])))
        if stage == "mixing":
            assert not own - Counter({k: 3 * n for k, n in Counter(before).items()})
            taken, goal = Counter(), {}
            for r in mixing.mix(given).collect():
                taken[r.doc_id] += len(r.shards)
            assert Counter(i for i, _ in own.elements()) == +taken
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            have = Counter()
            for r in rows:
                have[r.source] += size(r.text or "")
            goal = mixing.targets(given.sparkSession.createDataFrame(list(have.items()), "source string, source_size long")).collect() if have else []
            for g in goal:  # a draw on the edge of its source's last pass gives its whole row
                got = sum(size(r.text or "") for r in after if r.source == g.source)
                assert g.target - 1 <= got <= g.target + 17 * max((size(r.text or "") for r in rows if r.source == g.source), default=0)
        if stage == "packing":
            want = Counter()
            for (i, _), ids in zip(before, token_ids([t for _, t in before]), strict=True):
                ids = np.array([*ids, 1], "<u4")
                for n, lo in enumerate(range(0, len(ids), 4096)):
                    want[i, n, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())] += 1
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
            sequences = defaultdict(list)
            for r in after:
                sequences[r.sequence_id].append((r.offset, r.length))
            for own in sequences.values():
                own.sort()
                assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(own)) and sum(own[-1]) <= 4096


def test_language_stage_runs_the_fusion(spark, sf, monkeypatch):
    """The stage writes the fused verdicts of op8, and keeps the rows that they keep."""
    fuse, written, materialise = language_id.fuse, {}, language_id.materialise
    calls = []
    monkeypatch.setattr(language_id, "fuse", lambda *a, **k: calls.append(1) or fuse(*a, **k))
    monkeypatch.setattr(language_id, "materialise", lambda df, name, *a: written.setdefault(name, materialise(df, name, *a)) if name == "verdicts" else materialise(df, name, *a))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.language(spark, docs, sf)
    assert calls and "verdicts" in written
    want = language_id.language_id(docs).collect()
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in want if r.kept)
    assert Counter((r.language, round(r.confidence, 6)) for r in written["verdicts"].collect()) == Counter((r.language, round(r.confidence, 6)) for r in want)


def test_mixing_stage_is_written_by_shard(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r["__shard"], r["__turn"], r.doc_id) for r in mixing.mixed_rows(docs).collect())
    assert [r.doc_id for r in corpus_pipeline.mixture(spark, docs, sf).collect()] == [i for *_, i in want]
