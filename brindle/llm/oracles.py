"""DuckDB SQL that must give the rows of the queries that SQL can express."""

from __future__ import annotations

from brindle.llm import ball_kmeans, filtering_lloyd
from brindle.llm.decontamination import IDENTITY, MASKS, SPAN, WINDOW
from brindle.llm.line_templates import DEPTH, FIXED, LEAST_WORDS, MIN_DOCS
from brindle.llm.mixing import BLOCK, MOST, SHARE, WEIGHTS
from brindle.llm.quality import RULES, STOP_WORDS
from brindle.llm.secrets import BASE, LEAST_CHARACTERS, MAX_OWNERS, MAX_REPOS
from brindle.llm.sharding import TABLE_SIZE, fill_table

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op2() -> str:
    """Windows as joined words, compared place by place."""
    tokens = lambda t: rf"list_filter(string_split_regex(lower(coalesce({t}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    masks = ", ".join("concat_ws(' ', " + f"'{k}', " + ", ".join(f"w[i + {o + 1}]" for o in mask) + ")" for k, mask in enumerate(MASKS))
    windows = lambda source, key: f"SELECT {key}, w, i, unnest([{masks}]) AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM {source} WHERE len(w) >= {SPAN})"
    return f"""WITH d AS (SELECT doc_id, {tokens("text")} AS w FROM documents), b AS (SELECT DISTINCT item_id, {tokens("text")} AS w FROM benchmark),
 ds AS ({windows("d", "doc_id")}), bs AS ({windows("b", "item_id")}),
 h AS (SELECT doc_id, item_id, ds.w AS dw, bs.w AS bw, ds.i - bs.i AS shift, least({WINDOW}, len(bs.w)) AS n, greatest(0, least(bs.i - {(WINDOW - SPAN) // 2}, len(bs.w) - least({WINDOW}, len(bs.w)))) AS f FROM ds JOIN bs USING (seed)),
 v AS (SELECT doc_id, item_id, 100.0::DOUBLE * len(list_filter(range(f, f + n), lambda k: k + shift >= 0 AND k + shift < len(dw) AND dw[k + shift + 1] = bw[k + 1])) / n AS identity FROM h),
 p AS (SELECT doc_id, item_id, count(*) AS n_seeds, max(identity) AS identity FROM v WHERE identity >= {IDENTITY} GROUP BY doc_id, item_id)
 SELECT doc_id, count(*) AS n_items, sum(n_seeds)::BIGINT AS n_seeds, max(identity) AS identity, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM p GROUP BY doc_id"""


def op3() -> str:
    """Counts by lists and, for repeated windows, by rows of (document, place)."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ratio = lambda a, b: f"coalesce({a} / nullif({b}::DOUBLE, 0), 0)"
    metrics = {
        "n_words": "n_words",
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
        "upper_ratio": ratio("n_upper", "n_letters"),
        "bullet_line_ratio": ratio("n_bullets", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipses", "n_lines"),
    }
    bounds = [f"{metrics[r.metric]} >= {r.least}" for r in RULES if r.least is not None] + [f"{metrics[r.metric]} <= {r.most}" for r in RULES if r.most is not None]
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM t),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
 h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
 r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
 m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda x: x IN ({stop}))) AS n_stop, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\p{{L}}')) AS n_letters,
  len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses
  FROM w LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM b"""


def op4() -> str:
    """Places from the lengths of matches and of what lies between them."""
    assign = BASE[0].pattern.replace("'", "''")
    kinds = (("assign", assign, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("owned", "[A-Za-z0-9_-]+", 0, 20))
    parts = []
    for k, (name, pattern, group, least) in enumerate(kinds):
        # Runs of one class are listed only if they are long: the others are dropped anyway.
        scanned = pattern if name in ("assign", "access") else pattern[:-1] + f"{{{least},}}"
        parts.append(
            f"""SELECT doc_id, source, repo, {k} AS kind, '{name}' AS name, m[i] AS match, v[i] AS value,
 list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
 FROM (SELECT doc_id, source, repo, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, md5(text) AS repo, regexp_extract_all(text, '{scanned}') AS m,
 regexp_extract_all(text, '{scanned}', {group}) AS v, string_split_regex(text, '{scanned}') AS g FROM documents WHERE text IS NOT NULL))
 WHERE length(v[i]) >= {least}"""
            + (" AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[A-Z]')" if name == "owned" else "")
        )
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
 o AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY value),
 j AS (SELECT s.*, name || ':' || s || ':' || (s + length(match)) AS span, owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS} AND len(list_distinct(string_split(value, ''))) >= {LEAST_CHARACTERS} AS live,
  owners > {MAX_OWNERS} OR repos > {MAX_REPOS} AS example FROM s JOIN o USING (value)),
 d AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (example AND kind < 3) AS n_example FROM j GROUP BY doc_id)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM documents LEFT JOIN d USING (doc_id)"""


def op5() -> str:
    """Targets by the level of all sources below their bound; slots from whole
    numbers; words taken, copies and first slots from the blocks of the slots."""
    weights = f"[{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}]"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, md5(concat_ws(':', '1', doc_id, text)) AS key, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
 q AS (SELECT *, w, {MOST} * source_size / w AS ratio FROM (SELECT *, {weights}[k % {len(WEIGHTS)} + 1] AS w FROM r)),
 v AS (SELECT a.source, ({SHARE} * (SELECT sum(source_size) FROM q) - {MOST} * coalesce(sum(b.source_size), 0)) / (any_value(t.w) - coalesce(sum(b.w), 0)) AS level, any_value(a.ratio) AS ratio
  FROM q a CROSS JOIN (SELECT sum(w) AS w FROM q) t LEFT JOIN q b ON b.ratio < a.ratio GROUP BY a.source),
 x AS (SELECT min(ratio) AS first_ratio FROM v WHERE level <= ratio),
 l AS (SELECT any_value(level) AS level FROM v, x WHERE v.ratio = first_ratio),
 g AS (SELECT source, k, source_size, coalesce(least({MOST} * source_size::DOUBLE, w * level), {MOST} * source_size::DOUBLE) AS target FROM q LEFT JOIN l ON true),
 h AS (SELECT *, round(target)::BIGINT AS takes, (round(target)::BIGINT + {BLOCK - 1}) // {BLOCK} AS need FROM g),
 i AS (SELECT *, (sum(takes) OVER (ORDER BY k))::HUGEINT AS upto, (sum(takes) OVER ())::HUGEINT AS total FROM h),
 z AS (SELECT k, need, ((upto - takes) * 4294967296) // greatest(total, 1) AS low, (upto * 4294967296) // greatest(total, 1) AS high FROM i),
 u AS (SELECT slot, (slot * 2654435769) % 4294967296 AS u FROM (SELECT unnest(range(0, (SELECT coalesce(sum(need), 0)::BIGINT FROM h))) AS slot)),
 m AS (SELECT slot, k, need, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM u JOIN z ON u >= low AND u < high),
 o AS (SELECT h.k, need, coalesce(got, 0) AS got FROM h LEFT JOIN (SELECT k, count(*) AS got FROM m GROUP BY k) USING (k)),
 t AS (SELECT k, unnest(range(got, need)) AS rank FROM o WHERE got < need),
 w AS (SELECT k, rank, slot FROM m WHERE rank < need UNION ALL SELECT k, rank, (SELECT sum(need) FROM h)::BIGINT + row_number() OVER (ORDER BY rank, k) - 1 FROM t),
 p AS (SELECT d.*, h.k, h.source_size, h.target, h.takes, coalesce(sum(size) OVER (PARTITION BY h.k ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
 c AS (SELECT row, k, size, takes, unnest([{", ".join(f"place + {e} * source_size" for e in range(MOST))}]) AS start FROM p),
 b AS (SELECT *, least(start + size, takes) AS stop, unnest(range(start // {BLOCK}, (greatest(least(start + size, takes), start + 1) - 1) // {BLOCK} + 1)) AS rank FROM c WHERE start < takes),
 e AS (SELECT row, sum(least(stop, (rank + 1) * {BLOCK}) - greatest(start, rank * {BLOCK}))::BIGINT AS taken, count(*) FILTER (start // {BLOCK} = rank) AS copies, min(slot) AS first_slot FROM b JOIN w USING (k, rank) GROUP BY row)
 SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(copies, 0) AS copies, first_slot FROM p LEFT JOIN e USING (row)"""


def op7() -> str:
    """All pairs that share a shingle, and what is reached over links."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN [w[1]] ELSE [w[i], w[i + 1]] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 k AS (SELECT g, row_number() OVER () AS id FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
 f AS (SELECT doc_id, id FROM s JOIN k USING (g)),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.id = b.id AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT a AS doc_id, a AS reached FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a),
 m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def op9() -> str:
    """Templates as texts: fixed words, and nothing where a field is variable."""
    masked = ", ".join(f"CASE WHEN regexp_matches(coalesce(w[{k + 1}], ''), '[0-9]') THEN '<*>' ELSE coalesce(w[{k + 1}], '') END" for k in range(DEPTH))
    return rf"""WITH t AS (SELECT DISTINCT text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 r AS (SELECT text, k, regexp_extract_all(l[k + 1], '{_WORD}') AS w FROM (SELECT text, l, unnest(range(0, len(l))) AS k FROM t)),
 f AS (SELECT text, k, w, concat_ws(chr(1), len(w), {masked}) AS leaf FROM r WHERE len(w) >= {LEAST_WORDS}),
 o AS (SELECT * FROM f WHERE leaf IN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT text) >= {MIN_DOCS})),
 p AS (SELECT text, k, leaf, place, w[place + 1] AS word FROM (SELECT *, unnest(range(0, len(w))) AS place FROM o)),
 c AS (SELECT *, NOT regexp_matches(word, '[0-9]') AND (place < {DEPTH} OR count(*) OVER (PARTITION BY leaf, place, word) >= {MIN_DOCS}) AS is_fixed FROM p),
 m AS (SELECT text, k, leaf || chr(2) || string_agg(CASE WHEN is_fixed THEN word ELSE '' END, chr(1) ORDER BY place) AS template FROM c GROUP BY text, k, leaf HAVING count(*) FILTER (is_fixed) >= {FIXED} * count(*)),
 g AS (SELECT text, list(k) AS gone FROM m WHERE template IN (SELECT template FROM m GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}) GROUP BY text)
 SELECT doc_id, coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
 CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
 FROM documents d LEFT JOIN g ON d.text = g.text"""


def op10(shards: tuple[str, ...]) -> str:
    """Placement by the filled table; the filling itself is tested by brute force."""
    owners = ",".join(shards[k] for k in fill_table(shards, TABLE_SIZE))
    slot = f"(('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT % {TABLE_SIZE})::INTEGER"
    return f"WITH t AS (SELECT string_split('{owners}', ',') AS t) SELECT doc_id, {slot} AS slot, t[{slot} + 1] AS shard FROM documents, t"


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def op11() -> str:
    """Every part compared with every entry of its codebook, round after round."""
    m = filtering_lloyd
    nearest = lambda k: f"""a{k} AS MATERIALIZED (SELECT r, part, min(far * {m.ENTRIES} + entry) AS best FROM (SELECT p.r, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS far
  FROM p JOIN b{k} b USING (part, place) GROUP BY p.r, p.part, b.entry) GROUP BY r, part)"""  # noqa: E731
    moved = lambda k: f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(u.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, best % {m.ENTRIES} AS entry, place, floor(sum(x) / count(*)::DOUBLE)::BIGINT AS x
  FROM a{k} JOIN p USING (r, part) GROUP BY part, best % {m.ENTRIES}, place) u USING (part, entry, place))"""  # noqa: E731
    rounds = ",\n ".join(f"{nearest(k)},\n {moved(k)}" for k in range(m.ROUNDS))
    return rf"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({m.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
 p AS MATERIALIZED (SELECT r, k // d AS part, k % d AS place, v[k + 1] AS x FROM (SELECT r, v, len(v) // {m.PARTS} AS d, unnest(range(len(v))) AS k FROM e)),
 b0 AS MATERIALIZED (SELECT part, r AS entry, place, x FROM p WHERE r < {m.ENTRIES}),
 {rounds},
 {nearest(m.ROUNDS)},
 c AS (SELECT r, string_agg(lower(printf('%02x', best % {m.ENTRIES})), '' ORDER BY part) AS code, sum(best // {m.ENTRIES})::BIGINT AS error FROM a{m.ROUNDS} GROUP BY r),
 h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{m.ROUNDS})
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN c USING (r), h"""


def op13() -> str:
    """Every vector compared with every centroid, round after round."""
    m = ball_kmeans
    nearest = lambda k: f"""a{k} AS MATERIALIZED (SELECT r, min(far * {m.CLUSTERS} + cluster) AS best FROM (SELECT p.r, c.cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS far
  FROM p JOIN c{k} c USING (place) GROUP BY p.r, c.cluster) GROUP BY r)"""  # noqa: E731
    moved = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, c.place, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT best % {m.CLUSTERS} AS cluster, place, floor(sum(x) / count(*)::DOUBLE)::BIGINT AS x
  FROM a{k} JOIN p USING (r) GROUP BY best % {m.CLUSTERS}, place) u USING (cluster, place))"""  # noqa: E731
    rounds = ",\n ".join(f"{nearest(k)},\n {moved(k)}" for k in range(m.ROUNDS))
    return rf"""WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{m.SALT}:' || vec_id)) - 1 AS r, vec_id, list_transform(embedding, lambda x: floor({m.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {m.DIMENSION} AND {_FINITE}),
 p AS MATERIALIZED (SELECT r, k AS place, v[k + 1] AS x FROM (SELECT r, v, unnest(range(len(v))) AS k FROM e)),
 c0 AS MATERIALIZED (SELECT r AS cluster, place, x FROM p WHERE r < {m.CLUSTERS}),
 {rounds},
 {nearest(m.ROUNDS)},
 h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{m.ROUNDS} GROUP BY cluster),
 s AS (SELECT r, (best % {m.CLUSTERS})::INTEGER AS cluster, best // {m.CLUSTERS} AS distance FROM a{m.ROUNDS})
 SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM s JOIN e USING (r) JOIN h USING (cluster)"""
