"""The clustering queries in DuckDB's SQL, built from common table expressions over ``raw_lines``."""

from __future__ import annotations

import re

_LINES = r"""stripped AS (SELECT line_no, rtrim(raw_line, chr(13) || chr(10)) AS line FROM raw_lines),
cut AS (SELECT line_no, split_part(line, chr(9), 1) AS read,
  CASE WHEN instr(line, chr(9)) > 0 THEN substr(line, instr(line, chr(9)) + 1) ELSE '' END AS rest FROM stripped WHERE line <> ''),
parsed AS MATERIALIZED (SELECT line_no, read, CASE WHEN n >= 1 THEN n ELSE 1 END AS cnt FROM (
  SELECT line_no, read, TRY_CAST(nullif(regexp_extract(rest, '^[ \t\n\x0B\f\r]*([+-]?[0-9]+)', 1), '') AS INT) AS n FROM cut))"""
_UNIQUE = """u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY read) - 1 AS idx, read, CAST(length(read) AS INT) AS len, cnt
  FROM (SELECT read, CAST(sum(cnt) AS BIGINT) AS cnt FROM parsed GROUP BY read))"""


def _code(gram: str, q: int) -> str:
    return " + ".join(f"(instr('ACGT', substr({gram}, {k + 1}, 1)) - 1) * {4 ** (q - 1 - k)}" for k in range(q))


def _grams(name: str, source: str, q: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT idx, pos, CAST({_code("g", q)} AS INT) AS code, read FROM (
  SELECT idx, read, CAST(k AS INT) AS pos, substr(read, CAST(k AS INT) + 1, {q}) AS g FROM (SELECT idx, read, unnest(range(length(read) - {q - 1})) AS k FROM {source}))
  WHERE regexp_full_match(g, '[ACGT]{{{q}}}'))"""


def _anchors(rounds: int) -> str:
    return f"anc(it, code) AS (SELECT 0, 108 UNION ALL SELECT it + 1, (13 * code + 95) % 256 FROM anc WHERE it < {rounds - 1})"


def _keys(name: str, grams: str, rounds: int, occurrences: int) -> str:
    symbol = lambda j: (
        f"CASE WHEN pos + {4 + j} >= length(read) THEN 4 WHEN instr('ACGT', substr(read, pos + {5 + j}, 1)) = 0 THEN 255 ELSE instr('ACGT', substr(read, pos + {5 + j}, 1)) - 1 END"
    )
    fold = " + ".join(f"({symbol(j)}) * {5 ** (5 - j)}" for j in range(6))
    return f"""{name} AS MATERIALIZED (SELECT idx, CAST(it AS INT) AS it, pos, CAST({fold} AS BIGINT) AS key FROM (
  SELECT idx, read, pos, it, row_number() OVER (PARTITION BY idx, it ORDER BY pos) AS nth FROM {grams} JOIN anc USING (code) WHERE it < {rounds}) WHERE nth <= {occurrences})"""


def _bucket_pairs(name: str, keys: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT x.idx AS a, y.idx AS b FROM {keys} x JOIN {keys} y USING (it, key)
  JOIN (SELECT it, key FROM {keys} GROUP BY it, key HAVING count(*) BETWEEN 2 AND 4096) USING (it, key) WHERE x.idx < y.idx)"""


def _signatures(name: str, grams: str) -> str:
    words = ", ".join(f"coalesce(bit_or(CASE WHEN least(pos // 22, 5) = {b} THEN CAST(1 AS UBIGINT) << code END), CAST(0 AS UBIGINT)) AS s{b}" for b in range(6))
    return f"{name} AS MATERIALIZED (SELECT idx, {words} FROM {grams} GROUP BY idx)"


_ZERO = "CAST(0 AS UBIGINT)"
_BITS = " + ".join(f"CAST(bit_count(xor(coalesce(x.s{b}, {_ZERO}), coalesce(y.s{b}, {_ZERO}))) AS INT)" for b in range(6))


def _filtered(name: str, pairs: str, left: str, right: str, left_sigs: str, right_sigs: str, theta: int, tau: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT a, b, CAST(d AS INT) AS d FROM (SELECT a, b, apart(l.read, r.read) AS d FROM (
    SELECT a, b FROM (SELECT DISTINCT a, b FROM {pairs}) p LEFT JOIN {left_sigs} x ON x.idx = a LEFT JOIN {right_sigs} y ON y.idx = b WHERE {_BITS} <= {theta})
  JOIN {left} l ON l.idx = a JOIN {right} r ON r.idx = b WHERE abs(length(l.read) - length(r.read)) <= {tau}) WHERE d <= {tau})"""


def _reach(name: str, nodes: str, edges: str) -> str:
    """Smallest node of each component, walking only from smaller to larger nodes."""
    return f"""{name}_e AS MATERIALIZED (SELECT a AS u, b AS v FROM {edges} UNION SELECT b, a FROM {edges}),
{name}_r(node, seen) AS (SELECT u, u FROM {name}_e UNION SELECT e.v, r.seen FROM {name}_r r JOIN {name}_e e ON e.u = r.node WHERE r.seen < e.v),
{name} AS MATERIALIZED (SELECT n.idx, coalesce(min(seen), n.idx) AS label FROM {nodes} n LEFT JOIN {name}_r ON node = n.idx GROUP BY n.idx)"""


def _distances(sql: str) -> str:
    """``apart(x, y)`` as the distance over characters; DuckDB's own counts bytes, so each other character is made one."""
    plain = r"regexp_replace({}, '[^\x00-\x7F]', '~', 'g')"
    return re.sub(r"apart\(([\w.]+), ([\w.]+)\)", lambda m: f"levenshtein({plain.format(m[1])}, {plain.format(m[2])})", sql)


def reads_sql() -> dict[str, str]:
    """By query name."""
    return {name: _distances(sql) for name, sql in _queries().items()}


def _queries() -> dict[str, str]:
    lines = f"WITH RECURSIVE {_LINES}"
    reads = f"{lines}, {_UNIQUE}"
    grams = f"{reads}, {_grams('g4', 'u', 4)}, {_anchors(96)}"
    first = f"{grams}, {_keys('k1', 'g4', 64, 1)}"
    multi = f"{grams}, {_keys('k4', 'g4', 64, 4)}"
    sigs = f"{_grams('g3', 'u', 3)}, {_signatures('sig', 'g3')}"
    pairs = f"{multi}, {_bucket_pairs('p4', 'k4')}"
    edges = f"{pairs}, {sigs}, {_filtered('edges', 'p4', 'u', 'u', 'sig', 'sig', 60, 8)}"
    labels = f"{edges}, {_reach('lab', 'u', 'edges')}, sizes AS (SELECT label, count(*) AS n FROM lab GROUP BY label)"
    sample = f"""{labels}, sample AS MATERIALIZED (SELECT label AS core, idx, read FROM (
        SELECT label, idx, read, row_number() OVER (PARTITION BY label ORDER BY idx) AS nth FROM lab JOIN u USING (idx) JOIN sizes USING (label) WHERE n > 1) WHERE nth <= 64)"""
    heads = f"{labels}, h AS MATERIALIZED (SELECT idx, read FROM u WHERE idx IN (SELECT label FROM sizes WHERE n > 1)), rest AS MATERIALIZED (SELECT idx, read FROM lab JOIN sizes USING (label) JOIN u USING (idx) WHERE n = 1)"
    limit = f"{heads}, lim AS (SELECT CAST(greatest(4, floor(coalesce(median(length(read)), 0) * 0.5)) AS INT) AS dmax FROM h)"
    exact = f"""{limit}, hp AS MATERIALIZED (SELECT a, b, CAST(d AS INT) AS d FROM (SELECT x.idx AS a, y.idx AS b, apart(x.read, y.read) AS d
        FROM h x JOIN h y ON x.idx < y.idx WHERE abs(length(x.read) - length(y.read)) <= (SELECT dmax FROM lim)) WHERE d <= (SELECT dmax FROM lim))"""
    dense = lambda source: f"hist AS MATERIALIZED (SELECT CAST(k AS INT) AS d, coalesce(pairs, 0) AS pairs FROM (SELECT unnest(range(dmax + 1)) AS k FROM lim) LEFT JOIN (SELECT d, count(*) AS pairs FROM {source} GROUP BY d) ON d = k)"
    top = """occ AS (SELECT d, pairs FROM hist WHERE d >= 1 AND pairs > 0), pk AS (SELECT max_by(d, pairs * 100000 - d) AS peak FROM occ),
        steps AS (SELECT d, lead(d) OVER (ORDER BY d) AS nxt FROM occ, pk WHERE d <= peak), gap AS (SELECT max(d) AS lo FROM steps WHERE nxt - d - 1 >= 2),
        found AS (SELECT CASE WHEN peak IS NULL THEN 0 WHEN lo IS NULL THEN 2 ELSE 1 END AS kind, coalesce(peak, -1) AS peak,
          CASE WHEN lo IS NULL THEN 0 ELSE lo + 1 END AS gap_start, coalesce((SELECT nxt - d - 1 FROM steps WHERE d = lo), 0) AS gap_len,
          coalesce((SELECT nxt FROM steps WHERE d = lo), (SELECT min(d) FROM occ)) AS ceiling FROM pk, gap)"""
    filtered = f"""{limit}, {_grams('hg4', 'h', 4)}, {_keys('hk1', 'hg4', 96, 1)}, {_bucket_pairs('hb', 'hk1')},
        hf AS MATERIALIZED (SELECT a, b, d FROM (SELECT a, b, apart(l.read, r.read) AS d, l.read AS lr, r.read AS rr FROM (
          SELECT a, b FROM (SELECT DISTINCT a, b FROM hb) p LEFT JOIN sig x ON x.idx = a LEFT JOIN sig y ON y.idx = b WHERE {_BITS} <= 96)
          JOIN h l ON l.idx = a JOIN h r ON r.idx = b) WHERE abs(length(lr) - length(rr)) <= (SELECT dmax FROM lim) AND d <= (SELECT dmax FROM lim))"""
    merged = f"{exact}, near_edges AS (SELECT a, b FROM hp WHERE d <= 20), {_reach('lab3', 'h', 'near_edges')}"
    both = f"""{_grams('rg4', 'rest', 4)}, {_keys('rk', 'rg4', 96, 4)}, {_grams('hg4', 'h', 4)}, {_keys('hk4', 'hg4', 96, 4)}, both_sides AS (SELECT it, key FROM (SELECT it, key FROM rk UNION ALL SELECT it, key FROM hk4) GROUP BY it, key HAVING count(*) BETWEEN 2 AND 4096),
        sp AS MATERIALIZED (SELECT x.idx AS a, y.idx AS b FROM rk x JOIN hk4 y USING (it, key) JOIN both_sides USING (it, key))"""
    sided = f"{heads}, {both}"
    proposed = f"""{_filtered('sf', 'sp', 'rest', 'h', 'sig', 'sig', 96, 16)},
        prop AS (SELECT a AS idx, b AS core, d FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS nth FROM sf) WHERE nth = 1)"""
    closest = "coalesce((SELECT min(d) FROM hp JOIN lab3 x ON x.idx = a JOIN lab3 y ON y.idx = b WHERE x.label <> y.label AND d <= 41), 42)"
    near = "near AS MATERIALIZED (SELECT a, b, CAST(d AS INT) AS d FROM (SELECT x.idx AS a, y.idx AS b, apart(x.read, y.read) AS d FROM rest x JOIN h y ON abs(length(x.read) - length(y.read)) <= 16) WHERE d <= 16)"
    single = f"{labels}, {_keys('k1', 'g4', 64, 1)}, {_bucket_pairs('p1', 'k1')}, {_filtered('edges1', 'p1', 'u', 'u', 'sig', 'sig', 60, 8)}, {_reach('lab1', 'u', 'edges1')}"
    signed = ", ".join(f"CASE WHEN s{b} >= 9223372036854775808 THEN CAST(CAST(s{b} AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(s{b} AS BIGINT) END AS s{b}" for b in range(6))
    medoid = f"""{sample}, md AS (SELECT x.core, x.idx, x.read, CAST(sum(apart(x.read, y.read)) AS BIGINT) AS total FROM sample x JOIN sample y ON x.core = y.core AND x.idx <> y.idx GROUP BY 1, 2, 3),
        med AS MATERIALIZED (SELECT core, read AS medoid, total FROM (SELECT *, row_number() OVER (PARTITION BY core ORDER BY total, idx) AS nth FROM md) WHERE nth = 1),
        mem AS MATERIALIZED (SELECT core, medoid, u.idx, u.read FROM lab JOIN med ON med.core = lab.label JOIN u ON u.idx = lab.idx)"""
    resolved = f"""{merged}, {near}, best AS (SELECT a, min(d) AS d FROM near GROUP BY a),
        res AS (SELECT near.a AS idx, min(label) AS label FROM near JOIN best ON best.a = near.a AND best.d = near.d JOIN lab3 ON lab3.idx = b GROUP BY near.a HAVING min(label) = max(label))"""
    sinks = f"{labels}, named AS (SELECT x.idx, x.read, x.cnt, c.read AS centroid FROM lab JOIN u x ON x.idx = lab.idx JOIN u c ON c.idx = lab.label), numbered AS (SELECT row_number() OVER (ORDER BY line_no) AS line_no, read FROM parsed)"
    after = f"{reads}, nb AS (SELECT x.idx, x.read AS x, y.read AS y FROM u x JOIN u y ON y.idx = x.idx + 1)"
    return {
        "read_input": f"{lines} SELECT line_no, read, cnt FROM parsed",
        "line_numbers": f"{lines} SELECT row_number() OVER (ORDER BY line_no) AS line_no, read FROM parsed",
        "unique_reads": f"{reads} SELECT u.read, u.len, u.cnt, ids FROM u JOIN (SELECT read, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS ids FROM parsed GROUP BY read) USING (read)",
        "base_codes": f"{reads} SELECT CAST(k AS INT) AS pos, CAST(instr('ACGT', substr(read, CAST(k AS INT) + 1, 1)) - 1 AS INT) AS code, count(*) AS n FROM (SELECT read, unnest(range(length(read))) AS k FROM u) GROUP BY 1, 2",
        "anchor_grams": f"{grams} SELECT idx, pos, code FROM g4",
        "anchor_schedule": f"{reads}, {_grams('g4', 'u', 4)}, {_anchors(256)} SELECT CAST(it AS INT) AS it, CAST(anc.code AS INT) AS code, coalesce(n, 0) AS n FROM anc LEFT JOIN (SELECT code, count(*) AS n FROM g4 GROUP BY code) c ON c.code = anc.code",
        "signatures": f"{reads}, {sigs} SELECT idx, {signed} FROM sig",
        "anchor_keys_first": f"{first} SELECT idx, it, pos, key FROM k1",
        "anchor_keys_multi": f"{multi} SELECT idx, it, pos, key FROM k4",
        "candidate_pairs": f"{first}, {_bucket_pairs('p1', 'k1')} SELECT n, count(*) AS pairs FROM (SELECT a, b, count(*) AS n FROM p1 GROUP BY a, b) GROUP BY n",
        "candidate_pairs_multi": f"{pairs} SELECT n, count(*) AS pairs FROM (SELECT a, b, count(*) AS n FROM p4 GROUP BY a, b) GROUP BY n",
        "candidate_partners": f"{pairs} SELECT a, count(*) AS partners, CAST(sum(n) AS BIGINT) AS times, CAST(sum(b) AS BIGINT) AS indices FROM (SELECT a, b, count(*) AS n FROM p4 GROUP BY a, b) GROUP BY a",
        "signature_hamming": f"{first}, {_bucket_pairs('p1', 'k1')}, {sigs} SELECT CAST({_BITS} AS INT) AS bits, count(*) AS pairs FROM (SELECT DISTINCT a, b FROM p1) LEFT JOIN sig x ON x.idx = a LEFT JOIN sig y ON y.idx = b GROUP BY 1",
        "core_edges": f"{edges} SELECT a, b, d FROM edges",
        "s1_work_counters": f"""{pairs}, {sigs}, seen AS (SELECT a, b, n, {_BITS} <= 60 AS ok FROM (SELECT a, b, count(*) AS n FROM p4 GROUP BY a, b) LEFT JOIN sig x ON x.idx = a LEFT JOIN sig y ON y.idx = b)
            SELECT CAST(sum(n) AS BIGINT) AS cand, CAST(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS sig_pass, count(*) FILTER (WHERE ok) AS edit FROM seen""",
        "edit_distance": f"{after} SELECT idx, CAST(least(apart(x, y), 9) AS INT) AS within, CAST(apart(x, y) AS INT) AS exact FROM nb",
        "pigeonhole": f"""{after}, cutp AS (SELECT idx, x, y, t, t * length(x) // 9 AS s, (t + 1) * length(x) // 9 AS e FROM (SELECT *, unnest(range(9)) AS t FROM nb)),
            hits AS (SELECT DISTINCT idx FROM (SELECT idx, x, y, s, e, unnest(range(-8, 9)) AS m FROM cutp) WHERE s + m >= 0 AND e + m <= length(y)
              AND substr(x, CAST(s + 1 AS INT), CAST(e - s AS INT)) = substr(y, CAST(s + m + 1 AS INT), CAST(e - s AS INT)))
            SELECT length(x) < 9 OR hits.idx IS NOT NULL AS pass, apart(x, y) <= 8 AS near, count(*) AS pairs FROM nb LEFT JOIN hits USING (idx) GROUP BY 1, 2""",
        "connected_components": f"{labels} SELECT idx, label FROM lab",
        "cores_orphans": f"{labels} SELECT idx, CASE WHEN n > 1 THEN label END AS core FROM lab JOIN sizes USING (label)",
        "core_coverage": f"{labels} SELECT count(*) FILTER (WHERE n > 1) AS core_count, count(*) FILTER (WHERE n = 1) AS orphan_count, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS frac_reads_in_cores FROM sizes",
        "canonical_partition": f"{labels} SELECT idx, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab",
        "partition_differences": f"""{single}, ca AS (SELECT idx, dense_rank() OVER (ORDER BY label) AS c FROM lab), cb AS (SELECT idx, dense_rank() OVER (ORDER BY label) AS c FROM lab1)
            SELECT count(*) AS different FROM ca JOIN cb USING (idx) WHERE ca.c <> cb.c""",
        "s1_audit": f"""{labels}, spread AS (SELECT k * (SELECT count(*) FROM u) // 200 AS idx FROM (SELECT unnest(range(200)) AS k)),
            nbr AS (SELECT x.idx AS i, y.idx AS j FROM u x JOIN spread USING (idx) JOIN u y ON y.idx <> x.idx AND abs(x.len - y.len) <= 8 WHERE apart(x.read, y.read) <= 8)
            SELECT CAST(200 AS BIGINT) AS sampled, count(*) AS neighbours, count(*) FILTER (WHERE p.label <> q.label) AS cross, count(DISTINCT CASE WHEN p.label <> q.label THEN i END) AS reads_with_cross
            FROM nbr JOIN lab p ON p.idx = i JOIN lab q ON q.idx = j""".replace(" AS cross,", ' AS "cross",'),
        "medoid_sample": f"{sample} SELECT core, idx, read FROM sample",
        "medoid": f"{medoid} SELECT core, medoid, total FROM med",
        "alignment_scripts": f"{medoid} SELECT idx, CAST(apart(medoid, read) AS INT) AS cost, read AS made FROM mem",
        "vote_lengths": f"{medoid} SELECT core, CAST(sum(length(read) - length(medoid)) AS BIGINT) AS surplus FROM mem GROUP BY core",
        "vote_totals": f"""{medoid} SELECT core, CAST(max(length(medoid)) AS BIGINT) AS "columns", count(*) AS least, count(*) AS most FROM mem
            GROUP BY core HAVING bool_and(regexp_full_match(read, '[ACGT]+'))""",
        "merge_exact": f"{merged} SELECT idx, label FROM lab3",
        "merge_filtered": f"{filtered}, low AS (SELECT a, b FROM hf WHERE d <= 20), {_reach('labf', 'h', 'low')} SELECT idx, label FROM labf",
        "assembled": f"{resolved} SELECT lab.idx, coalesce(c.label, res.label, lab.idx) AS label FROM lab LEFT JOIN lab3 c ON c.idx = lab.label LEFT JOIN res ON res.idx = lab.idx",
        "cores_sizes": f"{sinks} SELECT centroid, CAST(sum(cnt) AS BIGINT) AS size FROM named GROUP BY centroid",
        "cores_members": f"{sinks} SELECT centroid, CAST(sum(cnt) AS BIGINT) AS size, string_agg(read, ',' ORDER BY read) AS members FROM named GROUP BY centroid",
        "cores_seq_id": f"""{sinks}, ids AS (SELECT centroid, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS ids FROM numbered JOIN named USING (read) GROUP BY centroid)
            SELECT centroid, CAST(sum(cnt) AS BIGINT) AS size, centroid AS members, any_value(ids) AS ids FROM named JOIN ids USING (centroid) GROUP BY centroid""",
        "cores_tidy": f"{sinks} SELECT line_no, read, centroid FROM numbered JOIN named USING (read)",
        "consensus_pairs": f"{exact} SELECT a, b, d FROM hp WHERE d <= 41",
        "dmax": f"{limit} SELECT dmax FROM lim",
        "distance_histogram": f"{exact} SELECT d, count(*) AS pairs FROM hp GROUP BY d",
        "histogram_dense": f"{exact}, {dense('hp')} SELECT d, pairs FROM hist",
        "ceiling": f"""{exact}, {dense('hp')}, {top}, top AS (SELECT kind, peak, gap_start, gap_len, coalesce(ceiling, (SELECT dmax + 1 FROM lim)) AS ceiling FROM found)
            SELECT CAST(kind AS INT) AS kind, CAST(peak AS INT) AS peak, CAST(gap_start AS INT) AS gap_start, CAST(gap_len AS INT) AS gap_len, CAST(ceiling AS INT) AS ceiling,
              CAST(greatest(2, least(ceiling - 1, CAST(floor((ceiling - 1) * CAST(0.75 AS DOUBLE)) AS INT))) AS INT) AS tau_safe FROM top""",
        "filtered_histogram": f"{filtered}, {dense('hf')} SELECT d, pairs FROM hist",
        "auto_tau": f"""{filtered}, {dense('hf')}, {top} SELECT CAST(kind AS INT) AS kind, CAST(coalesce(ceiling, -1) AS INT) AS ceiling,
            CAST(CASE WHEN kind = 0 THEN 0 ELSE least(greatest(2, CAST(floor((ceiling - 1) * CAST(0.75 AS DOUBLE)) AS INT)), ceiling - 1) END AS INT) AS tau FROM found""",
        "c_post": f"""{merged} SELECT CAST({closest} AS INT) AS c_post,
            (SELECT count(DISTINCT label) FROM lab3) AS components, (SELECT count(*) - count(DISTINCT label) FROM lab3) AS unions""",
        "absorb_candidates": f"{sided} SELECT a AS idx, count(*) AS proposals, count(DISTINCT b) AS strings FROM sp GROUP BY a",
        "absorb_filtered": f"{sided}, {proposed} SELECT idx, core, d FROM prop",
        "absorb_statistics": f"""{resolved}, {both}, {proposed}, ways AS (SELECT rest.idx, w.label AS was,
              CASE WHEN 2 * d < {closest} THEN 'fast' WHEN d + 16 <= 41 THEN 'local' ELSE 'full' END AS way FROM rest LEFT JOIN prop USING (idx) LEFT JOIN lab3 w ON w.idx = core),
            seen AS (SELECT ways.idx, way, was, CASE WHEN way = 'fast' THEN was ELSE res.label END AS now, n.a IS NOT NULL AS met FROM ways LEFT JOIN res ON res.idx = ways.idx LEFT JOIN (SELECT DISTINCT a FROM near) n ON n.a = ways.idx)
            SELECT count(*) FILTER (WHERE way = 'fast') AS fast, count(*) FILTER (WHERE way = 'local') AS "local", count(*) FILTER (WHERE way = 'full') AS "full",
              count(*) FILTER (WHERE way <> 'fast' AND was <> now) AS moved, count(*) FILTER (WHERE way <> 'fast' AND was IS NULL AND now IS NOT NULL) AS added,
              count(*) FILTER (WHERE way <> 'fast' AND met AND now IS NULL) AS tie_rejected, count(now) AS absorbed FROM seen""",
        "nearest_consensus": f"{heads}, {near} SELECT a AS idx, d, b AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS nth FROM near) WHERE nth = 1",
        "absorb_resolved": f"{resolved} SELECT idx, label FROM res",
        "absorb_exact": f"""{merged}, {near}, best AS (SELECT a, min(d) AS d FROM near GROUP BY a)
            SELECT near.a AS idx, min(b) AS core, min(near.d) AS d FROM near JOIN best ON best.a = near.a AND best.d = near.d JOIN lab3 ON lab3.idx = b GROUP BY near.a HAVING min(label) = max(label)""",
    }
