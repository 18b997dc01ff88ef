"""DuckDB SQL of the registered queries, written from the operators' definitions."""

from __future__ import annotations

from marginalia.queries import SEED

MANIFEST = """
    m AS (
        SELECT d.doc_id, n_chars, 'val' AS split, source || '.mp4' AS video, sha256(source || '.mp4') AS video_sha256,
            CASE WHEN d.doc_id % 2 = 0 THEN 'nextqa:val:' || source || ':' || d.doc_id ELSE 'star:val:' || d.doc_id END AS id,
            CASE WHEN d.doc_id % 2 = 0 THEN 'nextqa' ELSE 'star' END AS dataset,
            trim(replace(text, chr(10), ' '), ' ') AS question,
            list_slice(['Open', 'Close', 'Lift', 'Drop', 'Turn'], 1, 2 + d.doc_id % 4) AS choices,
            ((d.doc_id + 2 * quality + toxic) % (2 + d.doc_id % 4))::INT AS answer,
            CASE WHEN d.doc_id % 2 = 0 THEN ['CW', 'CH', 'TN', 'TC', 'TP', 'DC', 'DL', 'DO'][1 + (d.doc_id // 2) % 8]
                ELSE ['Interaction', 'Sequence', 'Prediction', 'Feasibility'][1 + (d.doc_id // 2) % 4] END AS question_type,
            CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE 1.5 * (d.doc_id % 7) END::DOUBLE AS start,
            CASE WHEN d.doc_id % 2 = 1 THEN 1.5 * (d.doc_id % 7) + 10 + n_chars % 20 END::DOUBLE AS "end"
        FROM documents d LEFT JOIN labels l USING (doc_id)
    )"""
FRAMES = """
    f AS (
        SELECT user_id AS clip, (row_number() OVER o - 1)::INT AS idx, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS t, value / 500 AS score
        FROM events WINDOW o AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)
    )"""
CLIPS = FRAMES + ", c AS (SELECT clip, list(t ORDER BY idx) AS t, list(score ORDER BY idx) AS score, count(*) AS n FROM f GROUP BY clip)"


def digits(xs: str) -> str:
    return f"array_to_string(list_transform({xs}, lambda q: round(q * 1000000)::BIGINT::VARCHAR), ',')"


def joined(xs: str) -> str:
    return f"array_to_string(list_transform({xs}, lambda q: q::VARCHAR), ',')"


def uniform(n: str, k: str) -> str:
    """Evenly spaced indices, halves to even."""
    size = f"least({n}, {k})"
    return f"CASE WHEN {size} = 1 THEN [({n} // 2)::INT] ELSE list_transform(range(0, {size}), lambda u: round_even(u * ({n} - 1) / greatest({size} - 1, 1), 0)::INT) END"


def mock(n_frames: str, alias: str = "") -> str:
    """Option scores of the stand-in answerer."""
    a = alias and alias + "."
    byte = f"(('0x' || substr(sha256({a}id || ':' || {n_frames}), 2 * (i + 1)::INT - 1, 2))::INT)"
    raw = f"list_transform(range(0, len({a}choices)), lambda i: 1 + {byte} / 255)"
    return f"list_transform({raw}, lambda v: v / list_sum({raw}))"


def ranked(scores: str, n: str) -> str:
    """Indices by score, highest first, of equals the smaller first."""
    return f"list_transform(list_sort(list_transform(range(0, {n}), lambda i: struct_pack(s := -{scores}[i + 1], i := i))), lambda r: r.i::INT)"


def argmax(s: str) -> str:
    return f"(list_position({s}, list_max({s})) - 1)::INT"


def margin(s: str) -> str:
    return f"(list_reverse_sort({s})[1] - list_reverse_sort({s})[2])"


def gap_fill(n: str, initial: str, budget: str) -> str:
    """Fold: add the index farthest from all chosen ones."""
    gap = "list_min(list_transform(acc, lambda j: abs(i - j)))"
    best = f"(-(list_max(list_transform(range(0, {n}), lambda i: struct_pack(gap := {gap}, minus := -i))).minus))::INT"
    step = f"CASE WHEN len(acc) < least({n}, {budget}) THEN list_append(acc, {best}) ELSE acc END"
    return f"list_sort(list_reduce(list_concat([{initial}], list_transform(range(0, {budget}), lambda z: NULL::INT[])), lambda acc, z: {step}))"


def evidence(n: str, t: str, initial: str, budget: str, q: str, a: str, b: str, near: str, weight: str) -> str:
    """Fold over (ids, anchors): alternate sides, then neighbours. A step's list holds only its number."""
    order = f"list_transform(list_sort(list_transform(range(0, {n}), lambda i: struct_pack(s := -(abs({a}[i + 1] - {b}[i + 1]) + {weight} * {q}[i + 1]), i := i))), lambda r: r.i::INT)"
    left = f"list_filter({order}, lambda i: NOT list_contains(acc.ids, i))"
    side = f"list_filter({left}, lambda i: ({a}[i + 1] >= {b}[i + 1]) = (len(acc.anchors) % 2 = 0))"
    pick = f"coalesce({side}[1], {left}[1])"
    before = "list_min(list_filter(range(0, {n}), lambda i: i < {p} AND {t}[{p} + 1] - {t}[i + 1] <= {near}))::INT"
    after = "list_max(list_filter(range(0, {n}), lambda i: i > {p} AND {t}[i + 1] - {t}[{p} + 1] <= {near}))::INT"
    p = "pk[1]"
    new = f"list_filter([{p}, {before.format(n=n, p=p, t=t, near=near)}, {after.format(n=n, p=p, t=t, near=near)}], lambda i: i IS NOT NULL AND NOT list_contains(acc.ids, i))"
    more = f"list_transform([[{pick}]], lambda pk: struct_pack(ids := list_concat(acc.ids, list_slice({new}, 1, least({n}, {budget}) - len(acc.ids))), anchors := list_append(acc.anchors, {p})))[1]"
    step = f"CASE WHEN len(acc.ids) < least({n}, {budget}) THEN {more} ELSE acc END"
    start = f"struct_pack(ids := {initial}, anchors := []::INT[])"
    return f"list_reduce(list_concat([{start}], list_transform(range(0, {budget}), lambda z: NULL::STRUCT(ids INT[], anchors INT[]))), lambda acc, z: {step})"


def relevance(text: str, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda w: sin(w * 0.7::DOUBLE + length({text})))"


def run(method: str, where: str = "") -> str:
    """CTEs up to ``r``: a run of the stand-in models with 64 frames, budget 16, first 8."""
    head = f"WITH {MANIFEST}, m0 AS (SELECT * FROM m {where})"
    if method == "uniform":
        return f"""{head}, r AS (SELECT *, {mock("16")} AS s1, NULL::DOUBLE[] AS s2, {uniform("64", "16")} AS i1, NULL::INT[] AS i2, false AS refined, 0 AS queries, NULL::INT[] AS anchors FROM m0),
            {finish()}"""
    if method == "topk":
        return f"""{head}, x AS (SELECT *, {relevance("question", "64")} AS rel FROM m0),
            r AS (SELECT *, {mock("16")} AS s1, NULL::DOUBLE[] AS s2, list_sort(list_slice({ranked("rel", "64")}, 1, 16)) AS i1, NULL::INT[] AS i2, false AS refined, 1 AS queries FROM x), {finish()}"""
    first = f"{head}, a0 AS (SELECT *, {mock('8')} AS s1, {mock('16')} AS sb, {uniform('64', '8')} AS i1, list_transform(range(0, 64), lambda i: start + 0.25 * i) AS times FROM m0), a AS (SELECT *, {margin('s1')} < 1 AS refined FROM a0)"
    if method == "refine":
        filled = f"(SELECT {gap_fill('64', uniform('64', '8'), '16')})"
        return f"{first}, r AS (SELECT *, CASE WHEN refined THEN sb END AS s2, CASE WHEN refined THEN {filled} END AS i2, 0 AS queries FROM a), {finish()}"
    pair = f"list_slice({ranked('s1', 'len(s1)')}, 1, 2)"
    return f"""{first}, b AS (SELECT *, {pair} AS pair FROM a),
        d AS (SELECT *, {relevance("question", "64")} AS rq, {relevance("question || ' ' || choices[pair[1] + 1]", "64")} AS ra, {relevance("question || ' ' || choices[pair[2] + 1]", "64")} AS rb FROM b),
        e AS (SELECT *, CASE WHEN refined THEN {evidence("64", "times", "i1", "16", "rq", "ra", "rb", "1.0", "0.25")} END AS ev FROM d),
        r AS (SELECT *, CASE WHEN refined THEN sb END AS s2, list_sort(ev.ids) AS i2, CASE WHEN refined THEN 1 + len(choices) ELSE 0 END AS queries FROM e), {finish()}"""


def finish() -> str:
    return f"""t AS (
        SELECT *, coalesce(s2, s1) AS scores, {argmax("coalesce(s2, s1)")} AS prediction, {argmax("s1")} AS first_prediction, {argmax("coalesce(s2, s1)")} = answer AS correct, n_chars / 1000 AS elapsed_seconds,
            (100 + 10 * len(i1) + CASE WHEN i2 IS NULL THEN 0 ELSE 100 + 10 * len(i2) END)::INT AS input_tokens, (len(i1) + coalesce(len(i2), 0))::INT AS frame_presentations, len(coalesce(i2, i1))::INT AS final_frames FROM r
    )"""


def trace(method: str) -> str:
    return f"""{run(method)} SELECT id, prediction, correct, round({margin("s1")}, 6) AS initial_margin, refined, queries::INT AS selector_queries, input_tokens, frame_presentations, final_frames,
        {joined("i1")} AS first_frames, coalesce({joined("i2")}, '') AS second_frames, {digits("scores")} AS scores FROM t"""


def nearest(n: str, f: float) -> str:
    return f"(1 + round_even(({n} - 1) * {f}::DOUBLE, 0))::BIGINT"


def _paired() -> str:
    left = run("uniform", "WHERE answer IS NOT NULL")
    right = run("evidence", "WHERE answer IS NOT NULL")
    return f"""WITH l AS ({left} SELECT id, dataset, video, correct FROM t), rr AS ({right} SELECT id, correct FROM t),
        k AS (SELECT dataset, video, sum(rr.correct::INT - l.correct::INT)::BIGINT AS diff, count(*) AS n, min(id) AS first_id FROM l JOIN rr USING (id) GROUP BY ALL)"""


KEY = f"sha256('[{SEED}, ' || to_json(id) || ']')"
STRIP = r"regexp_replace({x}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"
_BLANK_QUESTION = "CASE WHEN doc_id % 41 = 0 THEN '' ELSE question END"
_VECTORS = "list_transform(embedding, lambda x: x::DOUBLE)"
_HALVES = "list_reduce([[0, n], [], [], [], []], lambda b, z: list_append(flatten(list_transform(range(1, len(b)), lambda i: [b[i], (b[i] + b[i + 1]) // 2])), b[-1]))"
_BEST = "list_transform(list_sort(list_transform(range(b[p], b[p + 1]), lambda i: struct_pack(s := -score[i + 1], i := i))), lambda r: r.i)[1]"

SQL: dict[str, str] = {
    "manifest_build": f"""WITH {MANIFEST} SELECT id, dataset, split, video, video_sha256, question, array_to_string(choices, '|') AS choices, answer, question_type, start, "end" FROM m""",
    "manifest_public": f"WITH {MANIFEST} SELECT id, question, len(choices)::INT AS n_choices FROM m",
    "manifest_violations": f"""
        WITH {MANIFEST}, d AS (
            SELECT CASE WHEN doc_id % 97 = 0 THEN '' ELSE id END AS id, split, {_BLANK_QUESTION} AS question,
                CASE WHEN doc_id % 53 = 0 OR doc_id % 59 = 0 OR doc_id % 61 = 0 THEN 1 ELSE 0 END AS bad_path, doc_id % 31 = 0 AS bad_hash,
                CASE WHEN doc_id % 43 = 0 THEN 1 WHEN doc_id % 47 = 0 THEN 0 ELSE len(choices) END AS fit, len(choices) + CASE WHEN doc_id % 43 = 0 THEN 1 - len(choices) WHEN doc_id % 47 = 0 THEN 1 ELSE 0 END AS n,
                answer + CASE WHEN doc_id % 37 = 0 THEN 9 ELSE 0 END AS answer, CASE WHEN doc_id % 67 = 0 THEN -1 WHEN doc_id % 71 = 0 THEN 'nan'::DOUBLE ELSE start END AS start,
                CASE WHEN doc_id % 73 = 0 THEN 0 ELSE "end" END AS "end" FROM m
        )
        SELECT unnest(['video_path', 'id_split', 'question', 'choices', 'answer', 'start', 'end', 'sha256']) AS rule, unnest([
            count(*) FILTER (bad_path = 1), count(*) FILTER (id = '' OR split = ''), count(*) FILTER (question = ''), count(*) FILTER (fit NOT BETWEEN 2 AND 5),
            count(*) FILTER (answer < 0 OR answer >= n), count(*) FILTER (isnan(start) OR start < 0), count(*) FILTER ("end" IS NOT NULL AND (isnan(start) OR "end" <= start)), count(*) FILTER (bad_hash)
        ]) AS violations FROM d""",
    "manifest_duplicates": f"WITH {MANIFEST} SELECT video || ':' || question_type AS id, count(*) AS n FROM m GROUP BY 1 HAVING n > 1",
    "adapter_flat": f"""WITH {MANIFEST} SELECT 'nextqa:val:' || replace(video, '.mp4', '') || ':' || doc_id AS id, dataset, split, replace(video, '.mp4', '') AS video_key, question,
        array_to_string(list_transform(range(0, 5), lambda i: 'choice ' || i || ' of ' || doc_id), '|') AS choices, answer, question_type, 0::DOUBLE AS start, NULL::DOUBLE AS "end" FROM m WHERE dataset = 'nextqa'""",
    "adapter_nested_choices": f"""WITH {MANIFEST} SELECT 'star:val:' || question_type || '_T1_' || doc_id AS id, replace(video, '.mp4', '') AS video_key,
        array_to_string(list_transform(choices, lambda c: ' ' || c), '|') AS choices, answer, question_type, start, "end" FROM m WHERE dataset = 'star'""",
    "answer_text_match": f"""WITH {MANIFEST}, a AS (SELECT CASE WHEN answer IS NULL AND doc_id % 11 <> 0 THEN NULL WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN -1 ELSE answer END AS answer FROM m WHERE dataset = 'star')
        SELECT answer::INT AS answer, count(*) AS n FROM a GROUP BY 1""",
    "remap_left_join": f"""WITH {MANIFEST} SELECT id, replace(video, '.mp4', '') AS video_key, coalesce(n_name || '.part', replace(video, '.mp4', '')) AS stem
        FROM m LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) x ON 'src' || n_nationkey = replace(video, '.mp4', '')""",
    "index_inner_join": f"""WITH {MANIFEST} SELECT id, 'videos/src' || n_nationkey || '.mkv' AS video, sha256(n_name) AS video_sha256 FROM m JOIN nation ON 'src' || n_nationkey || '.mp4' = video WHERE n_nationkey < 15""",
    "unresolved_anti": f"WITH {MANIFEST} SELECT id, replace(video, '.mp4', '') AS stem FROM m WHERE video NOT IN (SELECT 'src' || n_nationkey || '.mp4' FROM nation WHERE n_nationkey < 15)",
    "annotation_ids_semi": f"WITH {MANIFEST} SELECT replace(video, '.mp4', '') AS stem, count(*) AS n FROM m WHERE video IN (SELECT 'src' || n_nationkey || '.mp4' FROM nation WHERE n_nationkey < 15) GROUP BY 1",
    "hash_subset_200": f"WITH {MANIFEST} SELECT id, {KEY} AS key FROM m ORDER BY 2, 1 LIMIT 200",
    "hash_subset_all": f"WITH {MANIFEST} SELECT id, substr({KEY}, 1, 16) AS key FROM m",
    "ids_digest": f"WITH {MANIFEST} SELECT sha256('[' || string_agg(to_json(id)::VARCHAR, ', ' ORDER BY id) || ']') AS ids_sha256, count(*) AS n FROM m",
    "pending_anti_join": f"WITH {MANIFEST} SELECT id, video, start FROM m WHERE NOT {KEY}[1] < '8'",
    "uniform_indices": f"WITH {CLIPS}, g AS (SELECT clip, n::INT AS n, k::INT AS k FROM c, (SELECT unnest([1, 2, 8, 16, 32]) AS k)) SELECT clip, n, k, {joined(uniform('n', 'k'))} AS ids FROM g",
    "topk_frames": f"WITH {FRAMES} SELECT clip, (row_number() OVER (PARTITION BY clip ORDER BY score DESC, idx))::INT AS rank, idx, round(score, 6) AS score FROM f QUALIFY rank <= 8",
    "topk_frames_array": f"WITH {CLIPS} SELECT clip, {joined('list_sort(list_slice(' + ranked('score', 'n') + ', 1, 8))')} AS ids FROM c",
    "topk_by_cosine": f"""WITH v AS (SELECT vec_id, label, {_VECTORS} AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 0),
        s AS (SELECT label AS clip, vec_id AS idx, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v, q)
        SELECT clip, (row_number() OVER (PARTITION BY clip ORDER BY score DESC, idx))::INT AS rank, idx, score FROM s QUALIFY rank <= 5""",
    "candidate_pool_asof": f"""WITH {FRAMES}, e AS (SELECT clip, max(t) AS e FROM f GROUP BY clip), b AS (SELECT clip, e, (i + 0.5) * e / 16 AS mid FROM e, range(0, 16) r(i))
        SELECT DISTINCT clip, idx, round(t, 6) AS t FROM (SELECT b.clip, mid, arg_min(idx, t) AS idx, min(t) AS t FROM b JOIN f ON b.clip = f.clip AND t >= mid AND t < e GROUP BY ALL)""",
    "neighbor_range_window": f"WITH {FRAMES} SELECT clip, idx, min(idx) OVER w AS earliest, max(idx) OVER w AS latest FROM f WINDOW w AS (PARTITION BY clip ORDER BY t RANGE BETWEEN 24.0::DOUBLE PRECEDING AND 24.0::DOUBLE FOLLOWING)",
    "minmax_normalize": f"WITH {CLIPS} SELECT clip, {digits('list_transform(score, lambda x: (x - list_min(score)) / (list_max(score) - list_min(score)))')} AS scaled FROM c",
    "segment_quota": f"WITH {CLIPS}, h AS (SELECT clip, score, {_HALVES} AS b FROM c) SELECT clip, {joined('list_sort(list_transform(range(1, len(b)), lambda p: ' + _BEST + '))')} AS ids, 'upstream' AS status FROM h",
    "gap_fill_16": f"WITH {CLIPS}, u AS (SELECT clip, n, {uniform('n', '8')} AS i FROM c) SELECT clip, {joined(gap_fill('n', 'i', '16'))} AS ids FROM u",
    "mock_scores": f"WITH {MANIFEST} SELECT id, {digits(mock('16'))} AS scores FROM m",
    "argmax_margin": f"WITH {MANIFEST}, s AS (SELECT id, {mock('16')} AS s FROM m) SELECT id, {argmax('s')} AS prediction, round({margin('s')}, 6) AS margin FROM s",
    "competitors": f"WITH {MANIFEST}, s AS (SELECT id, {mock('16')} AS s FROM m) SELECT id, {joined('list_slice(' + ranked('s', 'len(s)') + ', 1, 2)')} AS competitors FROM s",
    "score_validity": f"WITH {MANIFEST} SELECT doc_id % 5 AS kind, count(*) FILTER (doc_id % 5 > 2) AS valid, count(*) AS n FROM m GROUP BY 1",
    "softmax_options": f"""WITH {MANIFEST}, e AS (SELECT id, list_transform(range(0, len(choices)), lambda i: exp(sin((doc_id + i)::DOUBLE))) AS e FROM m) SELECT id, {digits("list_transform(e, lambda x: x / list_sum(e))")} AS p FROM e""",
    "prompt_text": f"""WITH {MANIFEST} SELECT id, sha256('Answer the multiple-choice question using the video evidence. Timestamps are seconds in the source video. Select exactly one option letter.' || chr(10) || 'Question: ' || question || chr(10)
        || array_to_string(list_transform(range(0, len(choices)), lambda i: chr(65 + i::INT) || '. ' || choices[i + 1]), chr(10)) || chr(10) || 'Answer:') AS prompt_sha256 FROM m""",
    "frame_timeline": f"WITH {CLIPS} SELECT clip, n::INT AS n, 1.0::DOUBLE AS fps, round(list_max(t) + 0.001, 6) AS duration FROM c",
    "mock_relevance_matrix": f"""WITH {MANIFEST}, x AS (SELECT id, list_concat([question], list_transform(choices, lambda c: question || ' ' || c)) AS texts FROM m),
        y AS (SELECT id, unnest(range(0, len(texts)))::INT AS row, unnest(texts) AS text FROM x) SELECT id, row, {digits(relevance("text", "8"))} AS scores FROM y""",
    "infer_uniform": trace("uniform"),
    "infer_topk": trace("topk"),
    "infer_refine": trace("refine"),
    "infer_evidence": trace("evidence"),
    "accuracy_micro": f"{run('uniform')} SELECT count(*) AS completed_count, count(answer) AS labelled_completed, round(avg(correct::INT), 6) AS accuracy_completed FROM t",
    "accuracy_by_type": f"{run('uniform')} SELECT question_type, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM t WHERE answer IS NOT NULL GROUP BY 1",
    "accuracy_macro": f"{run('evidence')} SELECT round(avg(a), 6) AS macro_type_accuracy FROM (SELECT avg(correct::INT) AS a FROM t WHERE answer IS NOT NULL GROUP BY question_type)",
    "accuracy_ctd": f"{run('uniform')} SELECT upper(question_type[1]) AS letter, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM t WHERE answer IS NOT NULL AND dataset = 'nextqa' GROUP BY 1",
    "flip_counts": f"{run('evidence')} SELECT count(*) FILTER (first_prediction <> answer AND correct) AS wrong_to_right, count(*) FILTER (first_prediction = answer AND NOT correct) AS right_to_wrong FROM t WHERE answer IS NOT NULL",
    "cost_means": f"""{run("evidence")} SELECT round(avg(input_tokens), 6) AS mean_input_tokens, round(avg(1 + (i2 IS NOT NULL)::INT), 6) AS mean_vlm_calls, round(avg(frame_presentations), 6) AS mean_frame_presentations,
        round(avg(final_frames), 6) AS mean_final_frames, round(avg(refined::INT), 6) AS refinement_rate FROM t""",
    "refinement_rate": f"WITH {MANIFEST}, s AS (SELECT {mock('8')} AS s FROM m) SELECT len(s)::INT AS n_choices, count(*) AS n, round(avg(({margin('s')} < 0.15)::INT), 6) AS refinement_rate FROM s GROUP BY 1",
    "latency_summary": f"""WITH {MANIFEST}, v AS (SELECT list(n_chars / 1000 ORDER BY n_chars) AS v, count(*) AS n FROM m)
        SELECT round(list_avg(v), 6) AS latency_mean_seconds, round(v[{nearest("n", 0.5)}], 6) AS latency_p50_seconds, round(v[{nearest("n", 0.95)}], 6) AS latency_p95_seconds,
            round((SELECT sum(n_chars) FROM m) / 1000, 3) AS measured_question_seconds, true AS no_vram FROM v""",
    "nearest_rank_percentiles": f"""WITH v AS (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, v[{nearest("n", 0.025)}] AS p025, v[{nearest("n", 0.5)}] AS p50, v[{nearest("n", 0.95)}] AS p95 FROM v""",
    "distinct_nodes": "SELECT 'local' AS node",
    "paired_cluster_diff": f"{_paired()} SELECT * FROM k",
    "delta_accuracy": f"{_paired()} SELECT round(sum(diff) / sum(n), 6) AS delta_accuracy, sum(n)::BIGINT AS questions, count(*) AS videos FROM k",
    "bootstrap_ci_portable": f"""{_paired()}, o AS (SELECT *, row_number() OVER (ORDER BY first_id) - 1 AS slot, count(*) OVER () AS total FROM k),
        d AS (SELECT it, ('0x' || substr(sha256('{SEED}:' || it || ':' || slot), 1, 8))::BIGINT % total AS pick FROM o, range(0, 2000) r(it)),
        s AS (SELECT it, sum(diff) / sum(n) AS delta FROM d JOIN o ON o.slot = pick GROUP BY it), v AS (SELECT list(delta ORDER BY delta) AS v, count(*) AS n FROM s)
        SELECT round(v[{nearest("n", 0.025)}], 6) AS ci_low, round(v[{nearest("n", 0.975)}], 6) AS ci_high FROM v""",
    "export_predictions_csv_shape": f"""{run("uniform")} SELECT id, video, dataset, split, question_type, prediction, answer, CASE WHEN correct THEN 'True' WHEN NOT correct THEN 'False' END AS correct,
        round(elapsed_seconds, 6) AS elapsed_seconds, input_tokens, final_frames, 'False' AS refined, NULL::VARCHAR AS peak_vram_allocated_gib FROM t""",
    "resume_equals_whole": f"{run('evidence')} SELECT id, prediction, correct, refined, input_tokens, final_frames, {digits('scores')} AS scores FROM t",
}
SQL["manifest_json_lines"] = SQL["manifest_build"]
SQL["annotations_csv"] = SQL["annotations_parquet"] = f"""WITH {MANIFEST} SELECT 'nextqa:val:' || video || ':' || doc_id AS id, video AS video_key, 'say "' || question || '", then?' AS question,
        'choice, 0|choice, 1|choice, 2|choice, 3|choice, 4' AS choices, answer, question_type FROM m WHERE dataset = 'nextqa'"""
SQL["annotations_json_array"] = SQL["adapter_nested_choices"]
SQL["journal_sorted_scan"] = f"{run('uniform')} SELECT id, prediction, correct, input_tokens, final_frames FROM t"
_CLIP_EVIDENCE = f"""WITH {CLIPS}, x AS (SELECT clip, n, t, score, list_reverse(score) AS other, {uniform("n", "8")} AS i FROM c),
    y AS (SELECT *, list_transform(range(0, n), lambda u: other[(u * 7 + 3) % n + 1]) AS question FROM x),
    e AS (SELECT clip, {evidence("n", "t", "i", "16", "question", "score", "other", "12.0", "0.25")} AS ev FROM y)"""
SQL["evidence_16"] = f"{_CLIP_EVIDENCE} SELECT clip, {joined('list_sort(ev.ids)')} AS ids FROM e"
SQL["evidence_anchors"] = f"{_CLIP_EVIDENCE} SELECT clip, {joined('ev.anchors')} AS anchors, len(ev.ids)::INT AS n FROM e"
SQL["infer_phases"] = SQL["infer_evidence"]
SQL["score_matrix_top5"] = f"""WITH v AS (SELECT label, vec_id, {_VECTORS} AS v FROM embeddings), u AS (SELECT label, vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM v),
    s AS (SELECT a.label AS "group", a.vec_id AS key, b.vec_id AS other, round(list_dot_product(a.v, b.v) / (a.size * b.size), 6) AS score FROM u a JOIN u b ON b.label = (a.label + 1) % 10)
    SELECT "group", key, (row_number() OVER (PARTITION BY key ORDER BY score DESC, other))::INT AS rank, other, score FROM s QUALIFY rank <= 5"""


def _linear(ids: str) -> str:
    """Option scores of the linear model with the frames of ``ids``."""
    logit = f"20 * list_avg(list_transform({ids}, lambda j: fr[j + 1][(length(question) + i) % 64 + 1]::DOUBLE))"
    e = f"list_transform(range(0, len(choices)), lambda i: exp({logit}))"
    return f"list_transform({e}, lambda v: v / list_sum({e}))"


def _cosines(text: str) -> str:
    return f"list_transform(range(0, n), lambda w: fr[w + 1][length({text}) % 64 + 1]::DOUBLE / size[w + 1])"


SQL["infer_arrow_model"] = f"""WITH {MANIFEST}, v AS (SELECT label AS clip, vec_id, embedding FROM embeddings), e AS (SELECT clip, (max(vec_id) + 1)::DOUBLE AS e FROM v GROUP BY clip),
    p AS (SELECT DISTINCT clip, vec_id, e FROM (SELECT clip, mid, min(vec_id) AS vec_id, min(e) AS e FROM (SELECT e.clip, e, (i + 0.5) * e / 64 AS mid FROM e, range(0, 64) r(i)) b JOIN v USING (clip) WHERE vec_id >= mid AND vec_id < e GROUP BY ALL)),
    f AS (SELECT p.clip, list(p.vec_id::DOUBLE * 16 / e ORDER BY p.vec_id) AS times, list(embedding ORDER BY p.vec_id) AS fr, list(sqrt(list_dot_product({_VECTORS}, {_VECTORS})) ORDER BY p.vec_id) AS size, count(*) AS n FROM p JOIN v USING (clip, vec_id) GROUP BY p.clip),
    g AS (SELECT m.*, f.*, {uniform("n", "8")} AS i1 FROM m JOIN f ON f.clip = m.doc_id % 10), a0 AS (SELECT *, {_linear("i1")} AS s1 FROM g), a AS (SELECT *, {margin("s1")} < 0.15 AND len(i1) < least(16, n) AS refined FROM a0),
    b AS (SELECT *, list_slice({ranked("s1", "len(s1)")}, 1, 2) AS pair FROM a),
    d AS (SELECT *, {_cosines("question")} AS rq, {_cosines("question || ' ' || choices[pair[1] + 1]")} AS ra, {_cosines("question || ' ' || choices[pair[2] + 1]")} AS rb FROM b),
    x AS (SELECT *, CASE WHEN refined THEN {evidence("n", "times", "i1", "16", "rq", "ra", "rb", "1.0", "0.25")} END AS ev FROM d),
    r AS (SELECT *, list_sort(ev.ids) AS i2, CASE WHEN refined THEN {_linear("list_sort(ev.ids)")} END AS s2, CASE WHEN refined THEN 1 + len(choices) ELSE 0 END AS queries FROM x), {finish()}
    SELECT id, prediction, correct, round({margin("s1")}, 6) AS initial_margin, refined, queries::INT AS selector_queries, input_tokens, frame_presentations, final_frames,
        {joined("i1")} AS first_frames, coalesce({joined("i2")}, '') AS second_frames, {digits("scores")} AS scores, true AS measured, 'float64' AS dtype FROM t"""
SQL["canonical_json_rows"] = f"""WITH {MANIFEST} SELECT id, sha256('{{"answer": ' || coalesce(answer::VARCHAR, 'null') || ', "choices": [' || array_to_string(list_transform(choices, lambda c: '"' || c || '"'), ', ')
    || '], "counts": {{"a": ' || length(question) || ', "z": ' || doc_id || '}}, "id": ' || to_json(id)::VARCHAR || ', "open": ' || ("end" IS NULL)::VARCHAR || ', "question": ' || to_json(question)::VARCHAR || '}}') AS row_sha256 FROM m"""
SQL["session_in_steps"] = SQL["resume_equals_whole"]


def segments(name: str, source: str, k: int, t1: float, depth: int) -> str:
    """CTEs up to ``name(clip, ids, status)``: segments of ``source(clip, score, n)`` halved in turn until their best stand out, and their quotas."""
    part = "list_slice(q, lo + 1, hi)"
    quota = f"greatest(1, floor({k} / pow(2, d)))::INT"
    lead = f"list_sum(list_slice(list_reverse_sort({part}), 1, {quota})) / least({quota}, hi - lo) - list_sum({part}) / (hi - lo)"
    split = f"d < deepest AND hi - lo >= 2 AND NOT {lead} > {t1}"
    best = f"list_slice(list_transform(list_sort(list_transform(range(lo, hi), lambda i: struct_pack(s := -q[i + 1], i := i))), lambda r: r.i::INT), 1, floor({k} / pow(2, d))::INT)"
    return f"""{name}_x AS (SELECT clip, n, n <= {k} OR list_max(score) = list_min(score) AS flat, least({depth}, floor(log2(n) + 1e-9))::INT AS deepest,
            list_transform(score, lambda x: (x - list_min(score)) / (list_max(score) - list_min(score))) AS q FROM {source}),
        {name}_s(clip, lo, hi, d) AS (SELECT clip, 0, n::INT, 0 FROM {name}_x WHERE NOT flat
            UNION ALL SELECT clip, CASE h WHEN 0 THEN lo ELSE (lo + hi) // 2 END, CASE h WHEN 0 THEN (lo + hi) // 2 ELSE hi END, d + 1 FROM {name}_s JOIN {name}_x USING (clip), (SELECT unnest([0, 1]) AS h) WHERE {split}),
        {name}_p AS (SELECT clip, list_sort(list_distinct(flatten(list({best})))) AS ids FROM {name}_s JOIN {name}_x USING (clip) WHERE NOT ({split}) GROUP BY clip),
        {name} AS (SELECT clip, CASE WHEN flat OR len(ids) = 0 THEN {uniform("n", str(k))} ELSE ids END AS ids,
            CASE WHEN flat THEN 'short_or_constant_uniform' WHEN len(ids) = 0 THEN 'zero_quota_uniform' WHEN deepest <> {depth} THEN 'depth_capped_short_clip' ELSE 'upstream' END AS status FROM {name}_x LEFT JOIN {name}_p USING (clip))"""


_RECURSIVE_CLIPS = CLIPS.strip()
SQL["segment_quota_adaptive"] = f"""WITH RECURSIVE {_RECURSIVE_CLIPS}, {segments("a", "c", 16, 0.8, 4)}, {segments("b", "c", 16, 0.3, 4)}
    SELECT clip, {joined("a.ids")} AS ids, a.status AS status, {joined("b.ids")} AS low_ids FROM a JOIN b USING (clip)"""
SQL["aks_guards"] = f"""WITH RECURSIVE {_RECURSIVE_CLIPS}, g0 AS (SELECT clip, list_slice(score, 1, clip % 40 + 1) AS part FROM c),
    g AS (SELECT clip, CASE WHEN clip % 5 = 0 THEN list_transform(part, lambda x: 0.5::DOUBLE) ELSE part END AS score, len(part) AS n FROM g0), {segments("a", "g", 8, 0.8, 4)}, {segments("b", "c", 8, 9.0, 4)}
    SELECT clip, a.status AS status, len(a.ids)::INT AS n, len(b.ids)::INT AS n_zero, b.status AS zero_status FROM a JOIN b USING (clip)"""
SQL["infer_segments"] = f"""WITH RECURSIVE {MANIFEST.strip()}, l AS (SELECT length(question) AS clip, count(*) AS rows FROM m GROUP BY 1),
    c AS (SELECT clip, 64 AS n, list_transform(range(0, 64), lambda w: sin(w * 0.7::DOUBLE + clip)) AS score FROM l), {segments("a", "c", 16, 0.8, 5)}
    SELECT status AS aks_status, 1::INT AS selector_queries, sum(rows)::BIGINT AS n FROM a JOIN l USING (clip) GROUP BY 1"""
_CAPTIONS = "list_transform(t, lambda x: 'Frame at ' || printf('%.3f', x * 3600) || 's:')"
SQL["frame_captions"] = f"WITH {CLIPS} SELECT clip, sha256(array_to_string({_CAPTIONS}, chr(10))) AS captions_sha256, array_to_string(list_slice({_CAPTIONS}, 1, 3), '|') AS first FROM c"
