import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from text_samples import prose
from tokenizers import Tokenizer

from tidemark.llm import jaccard, neighbours, packing
from tidemark.llm.jaccard import Band, drop_near_copies, hashed_shingles, in_reach, parity_sketch, plan_bands, shingles, signatures, similar_sets, words_of, WordHashes
from tidemark.llm.neighbours import hilbert_index, nearest
from tidemark.llm.packing import cut_pieces, fullest, pack, pack_lengths
from tidemark.llm.passages import repeated_passages
from tidemark.llm.tokens import VOCABULARY


def components(sets, percent):
    name = {k: k for k in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("listed", [48, 2])
def test_components_by_brute_force(spark, sf, width, percent, listed, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "TILE", 5)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # Chains of near copies, and many texts that share most of a passage.
    for i in range(12):
        words = prose(50, 200).split()
        words[i * 5 : i * 5 + 3] = [f"x{i}", f"y{i}", f"z{i}"]
        rows.append((10_000 + i, " ".join(words)))
        rows.append((11_000 + i, prose(60, 60) + " " + prose(70 + i, 40)))
        rows.append((12_000 + i, " ".join(prose(90, 12).split()[: 8 + i % 5])))
    got = {r["doc_id"]: r for r in similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    sets = {i: shingles(words_of(t), width) for i, t in rows}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets, percent)


@pytest.mark.parametrize("tile", [256, 3])
def test_link_counts_by_brute_force(spark, tile, monkeypatch):
    """All links of a class count, also within a component, however the group is cut."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = []
    for i in range(14):
        words = prose(50, 200).split()
        words[i * 5 : i * 5 + 3] = [f"x{i}", f"y{i}", f"z{i}"]
        rows += [(100 + i, " ".join(words)), (200 + i, " ".join(prose(51, 120).split()[: 90 + 2 * i]))]
    rows += [(300, prose(52, 100)), (301, prose(52, 99)), (302, prose(53, 80)), (303, rows[0][1]), (304, prose(52, 100)), (205, prose(54, 70))]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(words_of(t), 3))
    near = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
    got = similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    nodes = {r["class_id"] for r in got}
    want = {i: sum(any(near(a, b) for a in sets[i] for b in sets[j]) for j in nodes if j != i) for i in nodes}
    assert {r["class_id"]: r["n_links"] for r in got} == want and max(want.values()) > 5


@pytest.mark.parametrize("spare", [0, 1, 4, 30])
@pytest.mark.parametrize("loose", [0, 1, 2, 3])
def test_signatures_meet(loose, spare):
    """Sets within reach share a signature, however many segments are loose or spare."""
    rng = np.random.default_rng(loose)
    band = [Band(40, 60, max(0, 7 + spare - 2 * loose), loose, spare)]
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 54).astype(np.uint64))
        drop = rng.integers(0, 4)
        b = np.unique(np.r_[a[drop:], rng.integers(0, 2**63, 6 - drop - rng.integers(0, 3)).astype(np.uint64)])
        assert len(a) + len(b) - 2 * len(np.intersect1d(a, b)) <= 6
        assert len(np.intersect1d(signatures(a, band, 90), signatures(b, band, 90)))


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_that_link_are_in_reach(percent):
    """Sketches of different lengths never exclude a link, and exclude most sets that are far apart."""
    rng = np.random.default_rng(percent)
    fresh = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    far = 0
    for _ in range(300):
        a = fresh(rng.integers(1, 3000))
        b = np.unique(np.r_[a[rng.integers(0, len(a) // 8 + 1) :], fresh(rng.integers(0, len(a) // 8 + 1))])
        common = len(np.intersect1d(a, b))
        links = 100 * common >= percent * (len(a) + len(b) - common)
        x, y = parity_sketch(a, percent), parity_sketch(b, percent)
        assert in_reach(len(a), len(b), x, y, percent) or not links
        c = fresh(len(a))
        far += in_reach(len(a), len(c), x, parity_sketch(c, percent), percent)
        block = lambda h, s, k: pa.array([{"b": k, "_part": k, "_s": len(h), "_parity": s}], pa.struct([("b", pa.int64()), ("_part", pa.int64()), ("_s", pa.int64()), ("_parity", pa.binary())]))
        assert jaccard._reach_matrix(block(a, x, 1), block(b, y, 2), percent)[0, 0] == in_reach(len(a), len(b), x, y, percent)
    assert far < 15


def test_bands_cover_all_sizes():
    bands = plan_bands({0: 5, 3: 10**9, 12: 4}, 90)
    covered = [s for b in bands for s in range(b.low, b.high + 1)]
    assert covered == list(range(1, covered[-1] + 1))
    assert all(b.exact + 2 * b.loose >= (b.high + b.high * 100 // 90) * 10 // 190 + 1 for b in bands)
    assert len(hashed_shingles([b"a"], 3, WordHashes())) == 1


def test_jaccard_cases(messy, empty):
    rows = similar_sets(messy).collect()
    assert len(rows) == messy.count() and similar_sets(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == 4 and by[5]["component_id"] == 5 and by[4]["n_shingles"] == 0
    assert by[None]["component_id"] is None and by[7]["n_shingles"] == by[8]["n_shingles"] == 1
    kept = drop_near_copies(messy)
    assert kept.columns == messy.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12]


def covered_words(rows, words):
    first, several = {}, set()
    runs = {i: [tuple(w[k : k + words]) for k in range(len(w) - words + 1)] for i, w in rows}
    for i, own in runs.items():
        for run in own:
            if first.setdefault(run, i) != i:
                several.add(run)
    out = {}
    for i, own in runs.items():
        here = {p for k, run in enumerate(own) if run in several for p in range(k, k + words)}
        if here:
            out[i] = here
    return out


def test_passages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    common = prose(123, 51)
    rows += [(20_000 + i, prose(200 + i, 30 + i) + " " + common + " " + prose(300 + i, 20)) for i in range(40)]
    rows += [(21_000, prose(400, 30) + " " + prose(123, 49) + " " + prose(401, 30))]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50 and r["partner_id"] != r["doc_id"]
    assert got == covered_words([(i, words_of(t)) for i, t in rows], 50)


def covered_by_operator(spark, rows):
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50 and r["partner_id"] != r["doc_id"]
    return got


def test_passages_whose_parts_are_common(spark):
    """Two texts share u H v; many others share only H v or only u H, and stand beside them in every order."""
    rows = []
    for case in range(20):
        words = prose(500 + case, 63).split()
        a, b, at = 30_000 + 1000 * case, 30_001 + 1000 * case, 0
        rows += [(i, f"{prose(600 + i % 7 + case, 20)} {' '.join(words)} {prose(700 + i % 7 + case, 20)}") for i in (a, b)]
        for i in range(40):
            rows.append((a + 100 + i, f"{prose(800 + i, 20)} other{i} {' '.join(words[14:])} x{i} {prose(900 + i, 20)}"))
            rows.append((a + 200 + i, f"{prose(1000 + i, 20)} y{i} {' '.join(words[:49])} z{i} {prose(1100 + i, 20)}"))
    want = covered_words([(i, words_of(t)) for i, t in rows], 50)
    assert all(30_000 + 1000 * case in want for case in range(20))
    assert covered_by_operator(spark, rows) == want


def test_passages_repeated_in_one_text(spark):
    """Rows of one text that tie, more than a batch edge carries over, still meet the other text."""
    rows = []
    for case in range(3):
        common = prose(123 + case, 52)
        rows.append((40_000 + 10 * case, " ".join(f"{prose(130 + case, 30)} {common}" for _ in range(25_000 if case == 1 else 300))))
        rows.append((40_001 + 10 * case, f"{prose(140 + case, 20)} {common} {prose(150 + case, 20)}"))
    assert covered_by_operator(spark, rows) == covered_words([(i, words_of(t)) for i, t in rows], 50)


def test_passage_cases(messy, empty):
    rows = repeated_passages(messy).collect()
    assert repeated_passages(empty).count() == 0
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["partner_id"]) for r in rows) == [(1, 0, 400, 2), (2, 0, 400, 1), (3, 0, 400, 1), (10, 80, 150, 11), (11, 90, 160, 10)]


def test_fullest_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.integers(1, 40, 8).tolist()
        room = int(rng.integers(1, 120))
        counts = {x: lengths.count(x) for x in lengths}
        chosen = fullest(counts, sorted(counts, reverse=True), room)
        best = max(s for s in (sum(x for i, x in enumerate(lengths) if m >> i & 1) for m in range(256)) if s <= room)
        assert sum(chosen) == best and all(chosen.count(x) <= counts[x] for x in chosen)


def test_packing(spark, sf, messy, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = pack(docs).toPandas()
    fill = rows.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048 and len(fill) <= -(-rows["length"].sum() // 2048) + 1
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    library = Tokenizer.from_file(VOCABULARY)
    for r in docs.limit(40).collect():
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        own = rows[rows["doc_id"] == r["doc_id"]].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"][1:] == 2048).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()
    assert pack(empty).count() == 0
    messy_rows = pack(messy).toPandas()
    assert len(messy_rows[messy_rows["doc_id"] == 4]) == 1 and messy_rows[messy_rows["doc_id"] == 4]["length"].tolist() == [1]
    assert len(messy_rows[messy_rows["doc_id"] == 8]) == 2 and messy_rows["doc_id"].isna().sum() >= 1


def test_workers_get_few_bytes_at_once(spark, monkeypatch):
    class Scale:
        """Gives each text of a batch as many ids as the batch has MB."""

        def __init__(self, path):
            pass

        def encode(self, texts):
            held = list(texts)
            return [bytes(4 * (sum(map(len, held)) >> 20))] * len(held)

    monkeypatch.setattr(packing, "Merger", Scale)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    lengths = [r["length"] for r in cut_pieces(docs).select("length").collect()]
    assert len(lengths) == 3000 and max(lengths) - 1 <= 4


def test_pack_lengths_leave_little():
    lengths = np.random.default_rng(1).integers(1, 1200, 3000).tolist()
    bins, offsets = pack_lengths(lengths, 2048)
    assert len(set(bins)) <= -(-sum(lengths) // 2048) + 1 and len(offsets) == 3000


def test_hilbert_neighbours_touch():
    side = 1 << 3
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    place = hilbert_index(cells, 3)
    assert sorted(place) == list(range(side**3))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_neighbours_by_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows += [(100_000, None), (100_020, [0.0] * 64), (100_040, [float("nan")] * 64), (100_060, [None] * 64), (100_080, []), (None, [1.0] * 64), (100_100, rows[3][1]), (100_120, rows[3][1])] + [(200_000 + i, rows[5][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS id", "embedding AS v", "vec_id AS key")
    got = {}
    for r in nearest(df, tile=256, window=32).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v for _, v in fine])
    ids = np.array([i for i, _ in fine])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        score = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -np.round(score, 12))) if ids[k] != q][:20]
        assert [i for i, _ in found] == ids[order].tolist()
        assert np.allclose([s for _, s in found], score[order], atol=1e-12)
    assert nearest(df.limit(0)).count() == 0
    few = nearest(df.where("vec_id IN (0, 1, 2)")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    rough = {}
    for r in nearest(df, window=32, widen=False).collect():
        rough.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(rough) == set(got)


def test_neighbours_in_no_more_tasks_than_partitions(spark):
    """No step runs a task for each pair of partitions; centres sent in several turns find the same."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)], "vec_id long, embedding array<double>").repartition(4)
    plain = [tuple(r) for r in nearest(df, tile=64, window=32).orderBy("query_id", "rank").collect()]
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    group, context = "neighbours-in-few-tasks", spark.sparkContext
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        context.setJobGroup(group, group)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(neighbours, "_BROADCAST_NUMBERS", 10, raising=False)
            got = [tuple(r) for r in nearest(df, tile=64, window=32).orderBy("query_id", "rank").collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for c, v in before.items():
            spark.conf.set(c, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i]
    assert got == plain and len(plain) == 600
    assert len(tasks) > 10 and max(tasks) < 5 * 23


def test_neighbours_of_repeated_rows(spark):
    """Copies of a row, or several vectors of one id, take one of the k places."""
    rng = np.random.default_rng(8)
    common = [float(x) for x in rng.standard_normal(8)]
    rows = [(1, common)] * 30 + [(20, common)] * 30 + [(i, common) for i in range(21, 60)]
    rows += [(2, [x * (1 + j / 1000) for x in common]) for j in range(60)]
    rows += [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(100, 140)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    best = lambda q: {i: max(float(np.dot(a, b)) for k, a in rows if k == q for j, b in rows if j == i) for i in {i for i, _ in rows} - {q}}
    assert set(got) == {20, 40, 100, 120}
    for q, found in got.items():
        score = best(q)
        assert found == sorted(score, key=lambda i: (-round(score[i], 9), i))[:20]
