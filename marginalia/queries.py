"""The registered queries: one per operator or family, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia import views
from marginalia.config import Config
from marginalia.functions import answers, selectors, text
from marginalia.operators import compare, frames, metrics, rules, score_matrix, subset
from marginalia.plans import inference, phases
from marginalia.plans.linear import LinearModel
from marginalia.schema import EXPORT, MANIFEST
from marginalia.sources import annotations, files, journal, scratch
from marginalia.sources import manifest as manifests
from marginalia.streaming import resume

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 18


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(name: str, c=None):
    return F.round(F.col(name) if c is None else c, 6).alias(name)


def listed(c):
    """An array of whole numbers as text, so that any engine's result compares alike."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def numbers(c):
    """An array of numbers as text of six decimals, rounded to whole millionths first."""
    return F.array_join(F.transform(c, lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")


# -- manifest and rules


@query
def manifest_build(spark, sf_dir):
    return views.manifest(spark, sf_dir).select(*[F.array_join("choices", "|").alias("choices") if c == "choices" else F.col(c) for c in MANIFEST.names])


@query
def manifest_public(spark, sf_dir):
    return views.manifest(spark, sf_dir).select("id", "question", F.size("choices").alias("n_choices"))


@query
def manifest_violations(spark, sf_dir):
    """A manifest with defects put in by rule, so that every rule counts something."""
    c = F.col
    rows = views.manifest(spark, sf_dir).select(
        F.when(c("doc_id") % 97 == 0, "").otherwise(c("id")).alias("id"), "split",
        F.when(c("doc_id") % 53 == 0, F.concat(F.lit("../"), "video")).when(c("doc_id") % 59 == 0, F.concat(F.lit("a\\..\\"), "video")).when(c("doc_id") % 61 == 0, F.concat(F.lit("c:/"), "video")).otherwise(c("video")).alias("video"),
        F.when(c("doc_id") % 31 == 0, F.substring("video_sha256", 1, 63)).otherwise(c("video_sha256")).alias("video_sha256"),
        F.when(c("doc_id") % 41 == 0, F.lit(" \u00a0\t")).otherwise(c("question")).alias("question"),
        F.when(c("doc_id") % 43 == 0, F.slice("choices", 1, 1)).when(c("doc_id") % 47 == 0, F.concat("choices", F.array(F.lit(" ")))).otherwise(c("choices")).alias("choices"),
        (c("answer") + F.when(c("doc_id") % 37 == 0, 9).otherwise(0)).alias("answer"),
        F.when(c("doc_id") % 67 == 0, -1.0).when(c("doc_id") % 71 == 0, F.lit(float("nan"))).otherwise(c("start")).alias("start"),
        F.when(c("doc_id") % 73 == 0, 0.0).otherwise(c("end")).alias("end"),
    )
    return rules.violations(rows)


@query
def manifest_duplicates(spark, sf_dir):
    return rules.duplicates(views.manifest(spark, sf_dir).select(F.concat_ws(":", "video", "question_type").alias("id")), "id")


@query
def adapter_flat(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).where("dataset = 'nextqa'")
    flat = rows.select(F.regexp_replace("video", "[.]mp4$", "").alias("video"), F.col("doc_id").cast("string").alias("qid"), "question", F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"), F.col("question_type").alias("type"), *[F.concat(F.lit(f"choice {i} of "), "doc_id").alias(f"a{i}") for i in range(5)])
    return annotations.flat(flat, "val").select("id", "dataset", "split", "video_key", "question", F.array_join("choices", "|").alias("choices"), "answer", "question_type", "start", "end")


def _nested(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).where("dataset = 'star'")
    shuffled = F.reverse(F.transform("choices", lambda x, i: F.struct(i.alias("choice_id"), F.concat(F.lit(" "), x).alias("choice"))))
    key = F.concat_ws("_", "question_type", F.lit("T1"), "doc_id")
    return rows.select(key.alias("question_id"), F.regexp_replace("video", "[.]mp4$", "").alias("video_id"), "start", "end", "question", F.get(F.col("choices"), F.col("answer")).alias("answer"), shuffled.alias("choices"))


@query
def adapter_nested_choices(spark, sf_dir):
    rows = annotations.nested(_nested(spark, sf_dir), "val")
    return rows.select("id", "video_key", F.array_join("choices", "|").alias("choices"), "answer", "question_type", "start", "end")


@query
def answer_text_match(spark, sf_dir):
    """How answers match their choices, with choices that repeat and answers that are not among them."""
    rows = _nested(spark, sf_dir).withColumn("doc", F.element_at(F.split("question_id", "_"), -1).cast("long"))
    answer = F.when(F.col("doc") % 11 == 0, F.lit("Fly")).otherwise(F.concat("answer", F.lit("  ")))
    choices = F.when(F.col("doc") % 13 == 0, F.transform("choices", lambda x: F.struct(x["choice_id"].alias("choice_id"), F.lit("Sit").alias("choice")))).otherwise(F.col("choices"))
    _, index = annotations.nested_choices(choices, answer)
    return rows.groupBy(index.alias("answer")).agg(F.count("*").alias("n"))


# -- joins


@query
def remap_left_join(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("id", F.regexp_replace("video", "[.]mp4$", "").alias("video_key"))
    nation = views.table(spark, sf_dir, "nation")
    remap = nation.select(F.concat(F.lit("src"), "n_nationkey").alias("video_key"), F.concat(F.lit("clips\\"), "n_name", F.lit(".part.MP4")).alias("path")).where("n_nationkey % 2 = 0")
    return annotations.remapped(rows, remap).select("id", "video_key", "stem")


def _index(spark, sf_dir):
    nation = views.table(spark, sf_dir, "nation").where("n_nationkey < 15")
    return nation.select(F.concat(F.lit("src"), "n_nationkey").alias("stem"), F.concat(F.lit("videos/src"), "n_nationkey", F.lit(".mkv")).alias("video"), F.sha2(F.col("n_name").cast("binary"), 256).alias("video_sha256"))


def _keyed(spark, sf_dir):
    return views.manifest(spark, sf_dir).select(F.col("id"), text.stem(F.col("video")).alias("stem"))


@query
def index_inner_join(spark, sf_dir):
    return _keyed(spark, sf_dir).join(_index(spark, sf_dir), "stem").select("id", "video", "video_sha256")


@query
def unresolved_anti(spark, sf_dir):
    return annotations.unresolved(_keyed(spark, sf_dir), _index(spark, sf_dir)).select("id", "stem")


@query
def annotation_ids_semi(spark, sf_dir):
    """Annotations with a video, counted by video."""
    return _keyed(spark, sf_dir).join(_index(spark, sf_dir), "stem", "left_semi").groupBy("stem").agg(F.count("*").alias("n"))


# -- subsets and digests


@query
def hash_subset_200(spark, sf_dir):
    chosen = subset.subset(views.manifest(spark, sf_dir), 200, SEED)
    return chosen.select("id", text.subset_key(F.col("id"), SEED).alias("key"))


@query
def hash_subset_all(spark, sf_dir):
    return subset.subset(views.manifest(spark, sf_dir), 0, SEED).select("id", F.substring(text.subset_key(F.col("id"), SEED), 1, 16).alias("key"))


@query
def ids_digest(spark, sf_dir):
    return subset.subset_digest(views.manifest(spark, sf_dir))


@query
def canonical_json_rows(spark, sf_dir):
    """Each manifest row's digest, of its JSON text with sorted keys."""
    rows = views.manifest(spark, sf_dir).select("id", "question", "choices", "answer", F.create_map(F.lit("z"), F.col("doc_id"), F.lit("a"), F.length("question").cast("long")).alias("counts"), F.isnull("end").alias("open"))
    whole = F.struct(*rows.columns)
    return rows.select("id", F.sha2(text.canonical_json(whole, rows.select(whole.alias("x")).schema["x"].dataType).cast("binary"), 256).alias("row_sha256"))


@query
def pending_anti_join(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    done = rows.where(F.substring(text.subset_key(F.col("id"), SEED), 1, 1) < "8").select("id")
    return subset.pending(rows, done).select("id", "video", "start")


# -- frame selection


def _clips(spark, sf_dir):
    return frames.arrays(views.frames(spark, sf_dir), "t", "score")


@query
def uniform_indices(spark, sf_dir):
    n = _clips(spark, sf_dir).select("clip", F.size("t").alias("n")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 8, 16, 32)])))
    return n.select("clip", "n", "k", listed(selectors.uniform(F.col("n"), F.col("k"))).alias("ids"))


@query
def topk_frames(spark, sf_dir):
    return frames.top_frames(views.frames(spark, sf_dir), 8).select("clip", "rank", "idx", six("score"))


@query
def topk_frames_array(spark, sf_dir):
    return _clips(spark, sf_dir).select("clip", listed(selectors.topk(F.col("score"), 8)).alias("ids"))


@query
def topk_by_cosine(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = vectors.where("vec_id = 0").select(F.col("embedding").alias("asked"))
    scored = vectors.join(F.broadcast(asked)).select("vec_id", "label", F.round(answers.cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    return frames.top_frames(scored.select(F.col("label").alias("clip"), F.col("vec_id").alias("idx"), "score"), 5).select("clip", "rank", "idx", "score")


@query
def candidate_pool_asof(spark, sf_dir):
    some = views.frames(spark, sf_dir)
    clips = some.groupBy("clip").agg(F.lit(0.0).alias("start"), F.max("t").alias("end"))
    return frames.candidate_pool(some, clips, 16).select("clip", "idx", six("t"))


@query
def neighbor_range_window(spark, sf_dir):
    return frames.neighbors(views.frames(spark, sf_dir), 24.0).select("clip", "idx", "earliest", "latest")


@query
def minmax_normalize(spark, sf_dir):
    return _clips(spark, sf_dir).select("clip", numbers(selectors.min_max(F.col("score"))).alias("scaled"))


@query
def aks_guards(spark, sf_dir):
    """Short, constant and zero-quota inputs, and a cut depth."""
    clips = _clips(spark, sf_dir)
    some = F.slice("score", 1, (F.col("clip") % 40 + 1).cast("int"))
    scores = F.when(F.col("clip") % 5 == 0, F.transform(some, lambda x: F.lit(0.5))).otherwise(some)
    found = selectors.segment_quota(scores, 8, depth=4)
    zero = selectors.segment_quota(F.col("score"), 8, depth=4, t1=9.0)
    return clips.select("clip", found["status"].alias("status"), F.size(found["ids"]).alias("n"), F.size(zero["ids"]).alias("n_zero"), zero["status"].alias("zero_status"))


@query
def segment_quota_adaptive(spark, sf_dir):
    """Segments that stand out stay whole, by the protocol's own thresholds."""
    found = selectors.segment_quota(F.col("score"), 16, depth=4)
    low = selectors.segment_quota(F.col("score"), 16, t1=0.3, depth=4)
    return _clips(spark, sf_dir).select("clip", listed(found["ids"]).alias("ids"), found["status"].alias("status"), listed(low["ids"]).alias("low_ids"))


@query
def segment_quota(spark, sf_dir):
    found = selectors.segment_quota(F.col("score"), 16, t1=9.0, depth=4)
    return _clips(spark, sf_dir).select("clip", listed(found["ids"]).alias("ids"), found["status"].alias("status"))


@query
def gap_fill_16(spark, sf_dir):
    n = F.size("t")
    return _clips(spark, sf_dir).select("clip", listed(selectors.gap_fill(n, selectors.uniform(n, 8), 16)).alias("ids"))


def _evidence(spark, sf_dir):
    n = F.size("t")
    other = F.reverse("score")
    clips = _clips(spark, sf_dir).withColumn("other", other).withColumn("question", F.transform("score", lambda x, i: F.get(F.col("other"), (i * 7 + 3) % n)))
    return clips.select("clip", selectors.evidence(F.col("t"), selectors.uniform(n, 8), 16, F.col("question"), F.col("score"), F.col("other"), 12.0, 0.25).alias("e"))


@query
def evidence_16(spark, sf_dir):
    return _evidence(spark, sf_dir).select("clip", listed(F.col("e.ids")).alias("ids"))


@query
def evidence_anchors(spark, sf_dir):
    return _evidence(spark, sf_dir).select("clip", listed(F.col("e.anchors")).alias("anchors"), F.size("e.ids").alias("n"))


# -- answers


@query
def mock_scores(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    return rows.select("id", numbers(answers.mock_scores(F.col("id"), F.size("choices"), 16)).alias("scores"))


@query
def argmax_margin(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("id", answers.mock_scores(F.col("id"), F.size("choices"), 16).alias("s"))
    return rows.select("id", answers.argmax(F.col("s")).alias("prediction"), six("margin", answers.margin(F.col("s"))))


@query
def competitors(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("id", answers.mock_scores(F.col("id"), F.size("choices"), 16).alias("s"))
    return rows.select("id", listed(answers.competitors(F.col("s"))).alias("competitors"))


@query
def score_validity(spark, sf_dir):
    """Valid and broken probability vectors."""
    rows = views.manifest(spark, sf_dir).select("doc_id", F.size("choices").alias("n"), answers.mock_scores(F.col("id"), F.size("choices"), 16).alias("s"))
    broken = F.when(F.col("doc_id") % 5 == 0, F.transform("s", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).when(F.col("doc_id") % 5 == 1, F.slice("s", 1, F.col("n") - 1)).when(F.col("doc_id") % 5 == 2, F.transform("s", lambda x: x * 1.001)).otherwise(F.col("s"))
    return rows.groupBy((F.col("doc_id") % 5).alias("kind")).agg(F.count_if(answers.valid(broken, F.col("n"))).alias("valid"), F.count("*").alias("n"))


@query
def softmax_options(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    logits = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.sin(F.col("doc_id") + i))
    return rows.select("id", numbers(answers.softmax(logits, F.size("choices"))).alias("p"))


@query
def prompt_text(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    return rows.select("id", F.sha2(answers.prompt(F.col("question"), F.col("choices")).cast("binary"), 256).alias("prompt_sha256"))


@query
def frame_timeline(spark, sf_dir):
    line = answers.timeline(F.col("t"))
    return _clips(spark, sf_dir).select("clip", line["total_num_frames"].alias("n"), line["fps"].alias("fps"), six("duration", line["duration"]))


@query
def frame_captions(spark, sf_dir):
    """What is said before each frame, in seconds."""
    return _clips(spark, sf_dir).select("clip", F.sha2(F.array_join(answers.captions(F.transform("t", lambda t: t * 3600)), "\n").cast("binary"), 256).alias("captions_sha256"), F.array_join(F.slice(answers.captions(F.transform("t", lambda t: t * 3600)), 1, 3), "|").alias("first"))


@query
def mock_relevance_matrix(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    every = F.concat(F.array("question"), F.transform("choices", lambda x: F.concat_ws(" ", "question", x)))
    texts = rows.select("id", F.posexplode(every).alias("row", "text"))
    return texts.select("id", "row", numbers(answers.mock_relevance(F.col("text"), 8)).alias("scores"))


# -- gated inference


def _trace(df: DataFrame, *more: Column) -> DataFrame:
    call = lambda k: listed(F.get(F.col("calls"), F.lit(k))["frame_indices"])
    return df.select("id", "prediction", "correct", six("initial_margin"), "refined", "selector_queries", "input_tokens", "frame_presentations", "final_frames", call(0).alias("first_frames"), F.coalesce(call(1), F.lit("")).alias("second_frames"), numbers(F.col("scores")).alias("scores"), *more)


@query
def infer_uniform(spark, sf_dir):
    return _trace(views.run(spark, sf_dir, "uniform"))


@query
def infer_topk(spark, sf_dir):
    return _trace(views.run(spark, sf_dir, "clip_topk"))


@query
def infer_refine(spark, sf_dir):
    return _trace(views.run(spark, sf_dir, "uniform_refine"))


@query
def infer_evidence(spark, sf_dir):
    return _trace(views.run(spark, sf_dir, "evidence"))


@query
def infer_segments(spark, sf_dir):
    return views.run(spark, sf_dir, "aks").groupBy("aks_status", "selector_queries").agg(F.count("*").alias("n"))


@query
def infer_phases(spark, sf_dir):
    """The gated evidence run in two phases: only refined rows are in the second."""
    rows = views.manifest(spark, sf_dir).drop("doc_id", "n_chars")
    config = Config(backend="mock", method="evidence", margin_threshold=1.0, limit=0)
    found = phases.infer(inference.with_mock_pool(rows, config.candidate_frames), config, inference.ColumnModels())
    gib = F.lit(None).cast("double")
    return _trace(inference.result_rows(found, F.lit(0.0), gib, gib, F.struct(F.lit("local").alias("node"))))


def _vector_clips(spark, sf_dir):
    """Labels of vectors as clips: up to 64 frames of each, evenly over its vectors, and their times."""
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("frame"))
    clips = vectors.groupBy("clip").agg(F.lit(0.0).alias("start"), (F.max("t") + 1).alias("end"))
    pool = frames.candidate_pool(vectors, clips, 64).join(clips.select("clip", "end"), "clip")
    return pool.select("clip", (F.row_number().over(Window.partitionBy("clip").orderBy("t")) - 1).alias("idx"), (F.col("t") * 16 / F.col("end")).alias("t"), "frame")


def model_run(spark, sf_dir, method="evidence"):
    """A run of the linear model over all questions, each about the frames of one label."""
    pool = scratch.written(_vector_clips(spark, sf_dir), "frames")
    times = pool.groupBy("clip").agg(F.array_sort(F.collect_list("t")).alias("times"))  # 64 at most
    rows = views.manifest(spark, sf_dir).withColumn("clip", (F.col("doc_id") % 10).cast("int")).drop("doc_id", "n_chars").join(times, "clip")
    return phases.results(rows, Config(backend="mock", method=method, limit=0), phases.ArrowModels(LinearModel, pool.drop("t")))


@query
def infer_arrow_model(spark, sf_dir):
    """Two phases with a model in Arrow functions, its scores, its scorer, and that it was measured."""
    found = model_run(spark, sf_dir)
    measured = (F.col("elapsed_seconds") > 0) & (F.col("peak_vram_allocated_gib") > 0) & (F.col("peak_vram_reserved_gib") > 0) & F.col("execution.node").isNotNull()
    return _trace(found, F.coalesce(measured, F.lit(False)).alias("measured"), F.col("execution.resolved_dtype").alias("dtype"))


@query
def score_matrix_top5(spark, sf_dir):
    """All vectors of one label with all of the next: each one's five of highest cosine."""
    vectors = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return score_matrix.top(vectors, vectors.withColumn("group", (F.col("group") + 9) % 10), 5, digits=6)


# -- metrics


@query
def accuracy_micro(spark, sf_dir):
    return metrics.accuracy(views.run(spark, sf_dir)).select("completed_count", "labelled_completed", six("accuracy_completed"))


@query
def accuracy_by_type(spark, sf_dir):
    return metrics.accuracy_by_type(views.run(spark, sf_dir)).select("question_type", "n", six("accuracy"))


@query
def accuracy_macro(spark, sf_dir):
    return metrics.accuracy_macro(views.run(spark, sf_dir, "evidence")).select(six("macro_type_accuracy"))


@query
def accuracy_ctd(spark, sf_dir):
    return metrics.accuracy_by_letter(views.run(spark, sf_dir)).select("letter", "n", six("accuracy"))


@query
def flip_counts(spark, sf_dir):
    return metrics.flips(views.run(spark, sf_dir, "evidence"))


@query
def cost_means(spark, sf_dir):
    df = metrics.costs(views.run(spark, sf_dir, "evidence"))
    return df.select(*[six(c) for c in df.columns])


@query
def refinement_rate(spark, sf_dir):
    """By number of choices, where the margin's threshold is the protocol's own."""
    config = Config(backend="mock", method="uniform_refine", limit=0)
    rows = inference.results(views.manifest(spark, sf_dir), config)
    return rows.groupBy(F.size("scores").alias("n_choices")).agg(F.count("*").alias("n"), six("refinement_rate", metrics.rate(F.col("refined"))))


@query
def latency_summary(spark, sf_dir):
    df = metrics.latency(views.run(spark, sf_dir))
    return df.select(six("latency_mean_seconds"), six("latency_p50_seconds"), six("latency_p95_seconds"), F.round("measured_question_seconds", 3).alias("measured_question_seconds"), F.col("peak_vram_allocated_gib").isNull().alias("no_vram"))


@query
def nearest_rank_percentiles(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    return metrics.nearest_rank(events, "value", {"p025": 0.025, "p50": 0.5, "p95": 0.95}, "event_type")


@query
def distinct_nodes(spark, sf_dir):
    return metrics.nodes(views.run(spark, sf_dir))


# -- paired comparison


def _pairs(spark, sf_dir):
    return compare.paired(views.run(spark, sf_dir, "uniform", labelled=True), views.run(spark, sf_dir, "evidence", labelled=True))


@query
def paired_cluster_diff(spark, sf_dir):
    return compare.clusters(_pairs(spark, sf_dir))


@query
def delta_accuracy(spark, sf_dir):
    return compare.delta(compare.clusters(_pairs(spark, sf_dir))).select(six("delta_accuracy"), "questions", "videos")


@query
def bootstrap_ci_portable(spark, sf_dir):
    return compare.portable_interval(compare.clusters(_pairs(spark, sf_dir))).select(six("ci_low"), six("ci_high"))


@query
def bootstrap_ci_seeded(spark, sf_dir):
    low, high = compare.seeded_interval(compare.clusters(_pairs(spark, sf_dir)))
    return spark.createDataFrame([(low, high)], "ci_low double, ci_high double").select(six("ci_low"), six("ci_high"))


# -- sinks and sessions


@query
def export_predictions_csv_shape(spark, sf_dir):
    rows = journal.csv_shape(views.run(spark, sf_dir))
    return rows.select(*[six(c) if c == "elapsed_seconds" else F.col(c).cast("string").alias(c) if c == "peak_vram_allocated_gib" else F.col(c) for c in EXPORT])


@query
def resume_equals_whole(spark, sf_dir):
    """Rows of a run committed by two streaming sessions; the second meets the first one's rows again."""
    folder = scratch.fresh(spark, "resume")
    rows = views.manifest(spark, sf_dir).drop("doc_id", "n_chars")
    config = Config(backend="mock", method="evidence", margin_threshold=1.0, limit=0)
    book = journal.Journal(spark, f"{folder}/run", inference.results(rows, config).schema)
    half = F.substring(text.subset_key(F.col("id"), SEED), 1, 1) < "8"
    for part in (rows.where(half), rows):
        part.write.mode("append").parquet(f"{folder}/manifest")
        source = spark.readStream.schema(MANIFEST).parquet(f"{folder}/manifest")
        resume.stream(source, config, book, f"{folder}/checkpoint").awaitTermination()
    return book.results().select("id", "prediction", "correct", "refined", "input_tokens", "final_frames", numbers(F.col("scores")).alias("scores"))


@query
def file_digests(spark, sf_dir):
    """The digest of every file of the tables."""
    return files.digests(spark, sf_dir).select("file", "length", "sha256")


@query
def session_in_steps(spark, sf_dir):
    """The same run by two sessions of several steps each, of which the first is ended early."""
    folder = scratch.fresh(spark, "session")
    rows = views.manifest(spark, sf_dir).select(*MANIFEST.names)
    with scratch.freeing(spark):
        rows.write.option("ignoreNullFields", "false").option("compression", "gzip").json(f"{folder}/manifest")
    config = Config(backend="mock", method="evidence", margin_threshold=1.0, limit=0)
    step = max(1, rows.count() // 5)
    for more in ({"max_new": 2 * step}, {"resume": True}):
        resume.run(spark, config, f"{folder}/manifest", f"{folder}/run", step=step, **more)
    _, found = journal.read_run(spark, f"{folder}/run", inference.results(rows.limit(0), config).schema)
    return found.select("id", "prediction", "correct", "refined", "input_tokens", "final_frames", numbers(F.col("scores")).alias("scores"))


@query
def manifest_json_lines(spark, sf_dir):
    """A manifest written as JSON lines and read again with its checks."""
    folder = scratch.fresh(spark, "manifest")
    views.manifest(spark, sf_dir).select(*MANIFEST.names).write.option("ignoreNullFields", "false").json(folder)
    return manifests.read(spark, folder).select(*[F.array_join("choices", "|").alias("choices") if c == "choices" else F.col(c) for c in MANIFEST.names])


def _flat_file(spark, sf_dir, kind):
    """Flat annotations as a file of a kind, their questions whole texts in quotes."""
    folder = scratch.fresh(spark, "annotations")
    rows = views.manifest(spark, sf_dir).where("dataset = 'nextqa'")
    flat = rows.select("video", F.col("doc_id").cast("string").alias("qid"), F.concat(F.lit('say "'), "question", F.lit('", then?')).alias("question"), F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"), F.col("question_type").alias("type"), *[F.lit(f"choice, {i}").alias(f"a{i}") for i in range(5)])
    if kind == "csv":
        flat.write.csv(folder, header=True, quote='"', escape='"', emptyValue="")
        found = annotations.read_csv(spark, folder)
    else:
        flat.write.parquet(folder)
        found = annotations.read_parquet(spark, folder)
    return annotations.flat(found, "val").select("id", "video_key", "question", F.array_join("choices", "|").alias("choices"), "answer", "question_type")


@query
def annotations_csv(spark, sf_dir):
    return _flat_file(spark, sf_dir, "csv")


@query
def annotations_parquet(spark, sf_dir):
    return _flat_file(spark, sf_dir, "parquet")


def _arrays(batches):
    """JSON arrays of the texts of a batch each."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(batch.column("j").to_pylist()) + "]"])], ["value"])


@query
def annotations_json_array(spark, sf_dir):
    """Nested annotations written as JSON arrays, with a field that must not be read."""
    folder = scratch.fresh(spark, "annotations")
    rows = _nested(spark, sf_dir).withColumn("situations", F.struct(F.lit(1).alias("leak")))
    arrays = rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).mapInArrow(_arrays, "value string")
    arrays.write.option("maxRecordsPerFile", 1).text(folder)  # an array is one file
    found = annotations.nested(annotations.read_nested(spark, folder), "val")
    return found.select("id", "video_key", F.array_join("choices", "|").alias("choices"), "answer", "question_type", "start", "end")


@query
def journal_sorted_scan(spark, sf_dir):
    """Results committed twice, the second time all of them, and read in order of id."""
    rows = views.run(spark, sf_dir)
    book = journal.Journal(spark, scratch.fresh(spark, "journal"), rows.schema)
    book.put(rows.where("dataset = 'star'"))
    book.put(rows)
    return book.results().orderBy("id").select("id", "prediction", "correct", "input_tokens", "final_frames")
