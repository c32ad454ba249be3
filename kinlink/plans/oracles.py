"""DuckDB SQL for the registered linkage queries, written from their definitions."""

from __future__ import annotations

from kinlink.functions import text
from kinlink.plans.queries import THRESHOLDS

_BRAND = "lower(replace(p_brand, '#', ' '))"
_REC = f"""rec AS (SELECT p_type AS grp, p_partkey AS id, CAST(p_partkey % 3 + 1 AS INT) AS src, lower(p_name) || ' ' || {_BRAND} AS name,
  p_size || ' ' || {_BRAND} || ' ' || lower(p_type) || ' ' || CAST(floor(p_retailprice) AS BIGINT) AS addr FROM part)"""
_NAME_GRAMS = "list_transform(range(1, length(name) + 2 - 2), lambda i: substr(' ' || name || ' ', i, 4))"
_ADDR_GRAMS = "list_concat(string_split(addr, ' '), list_transform(range(1, len(string_split(addr, ' '))), lambda i: string_split(addr, ' ')[i] || '_' || string_split(addr, ' ')[i + 1]))"


def _vectors(tag: str, grams: str, least: int) -> str:
    """Normalised TF-IDF postings {tag}v (grp, id, src, f, w) of rec."""
    return f"""{tag}t AS (SELECT grp, id, src, f, count(*) AS tf FROM (SELECT grp, id, src, unnest({grams}) AS f FROM rec) GROUP BY ALL),
{tag}d AS (SELECT grp, f, count(*) AS df FROM {tag}t GROUP BY ALL HAVING count(*) >= {least}),
{tag}w AS (SELECT t.grp, t.id, t.src, t.f, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM {tag}t t JOIN {tag}d d USING (grp, f) JOIN (SELECT grp, count(*) AS n FROM rec GROUP BY grp) USING (grp)),
{tag}v AS (SELECT grp, id, src, f, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM {tag}w)"""


def _capped(tag: str, cap: int) -> str:
    """{tag}p: {tag}v without the features that more than `cap` entities have, normalised again."""
    return f"""{tag}o AS (SELECT grp, f FROM {tag}v WHERE src = 1 GROUP BY ALL HAVING count(*) > {cap}),
{tag}p AS (SELECT grp, id, src, f, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM {tag}v ANTI JOIN {tag}o USING (grp, f))"""


def _cosines(tag: str) -> str:
    """{tag}c (grp, j, i1, cos) of records against entities over {tag}p."""
    return f"{tag}c AS (SELECT r.grp, r.id AS j, e.id AS i1, round(sum(r.w * e.w), 6) AS cos FROM {tag}p r JOIN {tag}p e USING (grp, f) WHERE r.src > 1 AND e.src = 1 GROUP BY ALL)"


def _topk(tag: str, k: int, key: str = "j", other: str = "i1") -> str:
    return f"{tag}r AS (SELECT * FROM (SELECT grp, j, i1, cos, CAST(row_number() OVER (PARTITION BY grp, {key} ORDER BY cos DESC, {other}) - 1 AS INT) AS rk FROM {tag}c WHERE cos > 0) WHERE rk < {k})"


def _channel(tag: str, grams: str, least: int, k: int) -> str:
    return ",\n".join((_vectors(tag, grams, least), _capped(tag, _CAPS[tag]), _cosines(tag), _topk(tag, k)))


# entities that a name's gram and an address's word may have
_CAPS = {"n": 20_000, "ad": 5_000}
_NAME5, _ADDR5 = _channel("n", _NAME_GRAMS, 2, 5), _channel("ad", _ADDR_GRAMS, 1, 5)
_COMB = f"""{_vectors("n", _NAME_GRAMS, 2)}, {_capped("n", _CAPS["n"])}, {_vectors("ad", _ADDR_GRAMS, 1)}, {_capped("ad", _CAPS["ad"])},
bu AS (SELECT grp, id, src, 'n:' || f AS f, w * 0.6 AS w FROM np UNION ALL SELECT grp, id, src, 'a:' || f, w FROM adp),
bp AS (SELECT grp, id, src, f, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM bu), {_cosines("b")}"""
_KEYS = """ks AS (SELECT grp, id, src, unnest(list_distinct(regexp_extract_all(addr, '[0-9]+')[1:CASE WHEN src = 1 THEN 3 ELSE 1 END])) AS number, string_split(addr, ' ')[2] AS loc, string_split(name, ' ')[2] AS tok FROM rec),
ky AS (SELECT DISTINCT grp, id, src, number || '|' || loc || '|' || tok AS key FROM ks),
kf AS (SELECT grp, key FROM ky WHERE src = 1 GROUP BY ALL HAVING count(*) <= 50),
kp AS (SELECT DISTINCT r.grp, r.id AS j, e.id AS i1 FROM ky r JOIN ky e USING (grp, key) JOIN kf USING (grp, key) WHERE r.src > 1 AND e.src = 1)"""

_PAIRS = """pairs AS (SELECT l_partkey AS r_id, l_orderkey AS s1_id, l_linenumber AS ln, round(l_discount * 9.9 + 0.005, 4) AS p, round(1 - l_tax * 10, 4) AS p2, CAST(l_suppkey % 2 AS INT) AS src3, l_returnflag = 'R' AS y, l_suppkey AS supp, l_quantity AS qty FROM lineitem)"""
_UNIQUE = _PAIRS + ",\nu AS (SELECT r_id, s1_id, max(p) AS p, max(p2) AS p2, max(src3) AS src3, bool_or(y) AS y, max(qty) AS qty FROM pairs GROUP BY ALL)"


def _context(key: str, v: str) -> dict[str, str]:
    return {
        "gap": f"round(max({v}) OVER (PARTITION BY {key}) - {v}, 6)",
        "rank": f"CAST(rank() OVER (PARTITION BY {key} ORDER BY {v} DESC) AS INT)",
        "second": f"round(coalesce(nth_value({v}, 2) OVER (PARTITION BY {key} ORDER BY {v} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6)",
        "others": f"round(CASE WHEN row_number() OVER (PARTITION BY {key} ORDER BY {v} DESC) = 1 THEN coalesce(nth_value({v}, 2) OVER (PARTITION BY {key} ORDER BY {v} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) ELSE max({v}) OVER (PARTITION BY {key}) END, 6)",
        "rest": f"round(sum({v}) OVER (PARTITION BY {key}) - {v}, 6)",
    }


def _case(table: dict[str, str], column: str = "t") -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {column} END"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_F = "CASE WHEN npred = 0 AND ntrue = 0 THEN 1.0 WHEN npred = 0 OR ntrue = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / npred) * (tp / ntrue) / (0.25 * (tp / npred) + tp / ntrue) END"
_PMF = "list_reduce(list_transform({q}, lambda x: [x]), lambda a, b: list_transform(range(1, len(a) + 2), lambda s: coalesce(a[s], 0.0) * (1 - b[1]) + coalesce(CASE WHEN s > 1 THEN a[s - 1] END, 0.0) * b[1]), [CAST(1.0 AS DOUBLE)])"

_NAMED = """named AS (SELECT p_partkey AS id,
  CASE WHEN p_size % 11 = 0 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' fka Old ' || lower(p_type)
       WHEN p_size % 7 = 0 THEN replace(p_name, 'o', '0') ELSE p_name END
  || CASE p_size % 5 WHEN 0 THEN ' Incorporated' WHEN 1 THEN '  & Sons Ltd' WHEN 2 THEN ' of France SA' WHEN 3 THEN ' (ID: ' || p_partkey || ') LLC' ELSE ' Company St' END AS business_name,
  '#00' || p_size || ', ' || CASE p_size % 4 WHEN 0 THEN 'Fourth Street' WHEN 1 THEN '12th Avenue' WHEN 2 THEN '58bis R. Hugo' ELSE 'Main Road' END || ', ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' City, ' || CASE p_size % 3 WHEN 0 THEN 'Arizona' WHEN 1 THEN 'TX' ELSE 'NULL' END AS business_address,
  CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'France' END AS country FROM part)"""
_PAIRED = _NAMED + ", two AS (SELECT a.id, a.business_name AS n1, a.business_address AS a1, b.business_name AS n2, b.business_address AS a2 FROM named a JOIN named b ON b.id = a.id + 1)"
_LEET = "CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 AND length(t) - length(regexp_replace(t, '[^0-9]', '', 'g')) >= 2 AND NOT regexp_full_match(t, '[0-9]+(st|nd|rd|th)') THEN translate(t, '0134578', 'oleastb') ELSE t END"
_TOKENS = "list_transform(list_transform(regexp_extract_all(replace(lower({c}), '&', ' and '), '[a-z0-9]+'), lambda t: " + _LEET + "), lambda t: " + _case(text.NAME_CANON) + ")"
_MARKED = "list_transform(" + _TOKENS + ", lambda t: CASE WHEN t IN " + _in(text.COUNTRY_WORDS) + " THEN 'zzcountry' ELSE t END)"
_STATES = {k: "s_us_" + v for k, v in text.US_STATES.items()}
_ADDRESS_WORD = _case(text.ADDRESS_CANON, "(" + _case(text.ORDINALS, "regexp_replace(t, '^0+([0-9])', '\\1')") + ")")

_NUMBERED = """li AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS a, list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS b FROM lineitem GROUP BY l_orderkey)"""
_SIM = "CASE WHEN {x} = {y} THEN 1.0 ELSE 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}), 1) END"
_LONGEST = "list_reduce(a, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END)"
_BOTH = "len(a) > 0 AND len(b) > 0"


def _relation(x: str, y: str) -> dict[str, str]:
    differ, same = f"({x} <> '' AND {y} <> '' AND {x} <> {y})", f"length({x}) = length({y})"
    unequal = f"len(list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) <> substr({y}, i, 1)))"
    cut2, cut1 = f"({differ} AND length({x}) = length({y}) + 1 AND starts_with({x}, {y}))", f"({differ} AND length({y}) = length({x}) + 1 AND starts_with({y}, {x}))"
    return {
        "eq": f"({x} <> '' AND {y} <> '' AND {x} = {y})", "trrec": cut2, "trs1": cut1, "pref": f"({differ} AND NOT {cut1} AND NOT {cut2} AND (starts_with({x}, {y}) OR starts_with({y}, {x})))",
        "off": f"({differ} AND abs(CAST(substr({x}, 1, 12) AS BIGINT) - CAST(substr({y}, 1, 12) AS BIGINT)) <= 10)", "sub": f"({differ} AND {same} AND {unequal} = 1)", "samelen": f"({differ} AND {same} AND {unequal} <> 1)",
    }


_WORDS = "regexp_extract_all(lower({c}), '[a-z]+')"
_TOK = "[A-Za-zÀ-ÿ0-9]+"
_COMPS = "list_filter(list_transform(string_split(lower({c}), ','), lambda x: trim(x)), lambda x: x <> '')"
_RISE = "CASE WHEN len({p}) < 2 THEN -1.0 ELSE round(len(list_filter(range(1, len({p})), lambda i: {p}[i + 1] > {p}[i])) / (len({p}) - 1), 6) END"
_NEAR = """rv AS (SELECT * FROM rec WHERE src > 1),
xt AS (SELECT grp, id, f, count(*) AS tf FROM (SELECT grp, id, unnest({g}) AS f FROM {r}) GROUP BY ALL),
xd AS (SELECT grp, f, count(*) AS df FROM xt GROUP BY ALL),
xw AS (SELECT grp, id, f, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM xt JOIN xd USING (grp, f) JOIN (SELECT grp, count(*) AS n FROM {r} GROUP BY grp) USING (grp) WHERE df <= 3000),
xv AS (SELECT grp, id, f, w / sqrt(sum(w * w) OVER (PARTITION BY grp, id)) AS w FROM xw),
xc AS (SELECT a.grp, a.id AS j, b.id AS nb, round(sum(a.w * b.w), 6) AS sim FROM xv a JOIN xv b USING (grp, f) WHERE a.id <> b.id GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= {m}),
near AS (SELECT grp, j, nb, sim FROM (SELECT *, row_number() OVER (PARTITION BY grp, j ORDER BY sim DESC, nb) AS rk FROM xc) WHERE rk <= 5)"""
_MET = f"WITH {_REC}, {_channel('n', _NAME_GRAMS, 2, 3)}, p AS (SELECT j, i1, cos AS p FROM nr), " + _NEAR.format(g=_ADDR_GRAMS, r="rv", m=0.2)


def _made() -> dict[str, str]:
    q: dict[str, str] = {}
    q["block_name_topk"] = f"WITH {_REC}, {_NAME5} SELECT * FROM nr"
    q["block_addr_topk"] = f"WITH {_REC}, {_ADDR5} SELECT * FROM adr"
    q["block_comb_topk"] = f"WITH {_REC}, {_COMB}, {_topk('b', 5)} SELECT * FROM br"
    q["block_rev_topk"] = f"WITH {_REC}, {_COMB}, {_topk('b', 3, 'i1', 'j')} SELECT * FROM br"
    q["channel_union"] = f"WITH {_REC}, {_NAME5}, {_ADDR5} SELECT grp, j, i1, coalesce(n.rk, 99) AS rk_name, coalesce(a.rk, 99) AS rk_addr, n.cos AS cos_name, a.cos AS cos_addr FROM nr n FULL JOIN adr a USING (grp, j, i1)"
    q["exact_cosine"] = f"WITH {_REC}, {_channel('ad', _ADDR_GRAMS, 1, 3)}, {_vectors('n', _NAME_GRAMS, 2)} SELECT grp, j, i1, coalesce((SELECT round(sum(x.w * y.w), 6) FROM nv x JOIN nv y USING (f) WHERE x.id = adr.j AND y.id = adr.i1), 0.0) AS cos_name FROM adr"
    q["key_channel"] = f"WITH {_REC}, {_KEYS} SELECT * FROM kp"
    q["key_channel_new_pairs"] = f"WITH {_REC}, {_KEYS}, {_NAME5} SELECT kp.* FROM kp ANTI JOIN nr USING (grp, j, i1)"
    q["candidate_union"] = f"WITH {_REC}, {_KEYS}, {_NAME5} SELECT grp, j, i1, 'name' AS channel FROM nr UNION ALL SELECT kp.*, 'key' FROM kp ANTI JOIN nr USING (grp, j, i1)"
    q["name_freq"] = f"WITH {_REC} SELECT id, count(*) FILTER (src = 1) OVER (PARTITION BY grp, name) AS r_name_freq_s1, count(*) OVER (PARTITION BY grp, name) AS r_name_freq_all, count(*) FILTER (src = 1) OVER (PARTITION BY grp, addr) AS r_addr_freq_s1 FROM rec"
    q["name_oov"] = f"WITH {_REC}, t AS (SELECT grp, id, src, unnest(string_split(name, ' ')) AS t FROM rec) SELECT id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM t e WHERE e.src = 1 AND e.grp = t.grp AND e.t = t.t) THEN 0.0 ELSE 1.0 END), 6) AS r_name_oov FROM t WHERE src > 1 GROUP BY id"
    q["idf_overlap"] = f"""WITH {_REC}, {_channel('n', _NAME_GRAMS, 2, 3)}, s AS (SELECT DISTINCT grp, id, unnest(string_split(addr, ' ')) AS t FROM rec), n AS (SELECT grp, count(*) AS n FROM rec GROUP BY grp),
d AS (SELECT grp, t, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM s JOIN n USING (grp) GROUP BY grp, t, n), z AS (SELECT s.id, s.t, idf FROM s JOIN d USING (grp, t)),
a AS (SELECT id, sum(idf) AS s, count(*) AS n FROM z GROUP BY id),
x AS (SELECT nr.j, nr.i1, coalesce(sum(e.idf), 0) AS w, count(e.idf) AS c FROM nr LEFT JOIN (z e JOIN z r USING (t)) ON e.id = nr.i1 AND r.id = nr.j GROUP BY ALL)
SELECT j, i1, round(w / (b.s + c2.s - w + 1e-6), 6) AS oa_iw_jac, round(w / (b.s + 1e-6), 6) AS oa_iw_cov1, round(w / (c2.s + 1e-6), 6) AS oa_iw_cov2, round(c / (b.n + c2.n - c + 1e-6), 6) AS oa_c_jac, CAST(c AS DOUBLE) AS oa_c_inter, CAST(b.n AS DOUBLE) AS oa_c_n1, CAST(c2.n AS DOUBLE) AS oa_c_n2, round(b.s - w, 6) AS oa_iw_miss1, round(c2.s - w, 6) AS oa_iw_miss2
FROM x JOIN a b ON b.id = i1 JOIN a c2 ON c2.id = j"""
    jp, jn, ip, in_ = _context("r_id", "p"), _context("r_id", "p2"), _context("s1_id", "p"), _context("s1_id", "p2")
    q["stage0_context"] = f"WITH {_PAIRS} SELECT r_id, s1_id, ln, p, p2, {jp['gap']} AS comb_jmax_gap, {jp['rank']} AS comb_jrank, {ip['gap']} AS comb_imax_gap, {jn['gap']} AS name_jmax_gap, {jn['rank']} AS name_jrank, {in_['gap']} AS name_imax_gap, count(*) OVER (PARTITION BY r_id) AS j_n, count(*) OVER (PARTITION BY s1_id) AS i_n FROM pairs"
    rq, iq = _context("r_id", "qty"), _context("s1_id", "qty")
    q["pair_context"] = f"WITH {_PAIRS} SELECT r_id, s1_id, ln, p, qty, {jp['gap']} AS cos_comb_rmax_gap, {jp['rank']} AS cos_comb_rrank, {jp['second']} AS cos_comb_r2nd, {ip['gap']} AS cos_comb_s1max_gap, {ip['rank']} AS cos_comb_s1rank, {rq['gap']} AS cos_name_rmax_gap, {rq['rank']} AS cos_name_rrank, {rq['second']} AS cos_name_r2nd, {iq['gap']} AS cos_name_s1max_gap, {iq['rank']} AS cos_name_s1rank, count(*) OVER (PARTITION BY r_id) AS r_ncand, count(*) OVER (PARTITION BY s1_id) AS s1_ncand FROM pairs"
    rank = "row_number() OVER (PARTITION BY r_id ORDER BY p DESC, s1_id)"
    q["prune_topm"] = f"WITH {_UNIQUE} SELECT r_id, s1_id, p FROM u QUALIFY {rank} <= 10 AND p >= 0.1"
    q["prune_sweep"] = f"WITH {_UNIQUE}, k AS (SELECT *, {rank} AS rk FROM u) SELECT top, floor, CAST(sum(CASE WHEN rk <= top AND p >= floor THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN rk <= top AND p >= floor AND y THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM k, (SELECT unnest([5, 8, 10, 12, 15]) AS top), (SELECT unnest([0.0001, 0.1, 0.5])::DOUBLE AS floor) GROUP BY ALL"
    q["collective_features"] = f"""WITH {_UNIQUE}, h AS (SELECT r_id, s1_id, p, src3, CAST(p >= 0.5 AS INT) AS hit FROM u), c AS (SELECT r_id, s1_id, src3, p AS p1, {jp['others']} AS p1_r_other_max, {jp['rank']} AS p1_r_rank, round(sum(p) OVER (PARTITION BY r_id), 6) AS p1_r_sum, {ip['rest']} AS p1_a_sum_excl,
CAST(sum(hit) OVER (PARTITION BY s1_id) - hit AS BIGINT) AS p1_a_nstrong_excl, CAST(sum(hit * src3) OVER (PARTITION BY s1_id) - hit * src3 AS BIGINT) AS p1_a_nstrong_s3_excl, CAST(sum(hit * (1 - src3)) OVER (PARTITION BY s1_id) - hit * (1 - src3) AS BIGINT) AS p1_a_nstrong_s2_excl, {ip['others']} AS p1_a_max_excl, {ip['rank']} AS p1_a_rank FROM h) SELECT *, round(p1 - p1_r_other_max, 6) AS p1_r_margin FROM c"""
    q["sibling_features"] = f"""WITH {_UNIQUE}, m AS (SELECT a.r_id, a.s1_id, b.r_id AS rs_id, b.p AS ps, CAST(CASE WHEN x.p_brand = z.p_brand THEN 0.75 WHEN abs(x.p_size - z.p_size) < 8 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS sim FROM u a JOIN u b ON a.s1_id = b.s1_id AND a.r_id <> b.r_id AND b.p >= 0.5 JOIN part x ON x.p_partkey = a.r_id JOIN part z ON z.p_partkey = b.r_id),
g AS (SELECT r_id, s1_id, max(sim) AS a, avg(sim) AS b, max(sim * ps) AS c, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT u.r_id, u.s1_id, u.p, coalesce(a, 0) AS smax, coalesce(b, 0) AS smean, coalesce(c, 0) AS swmax, coalesce(n, 0) AS sib_n FROM u LEFT JOIN g USING (r_id, s1_id))
SELECT r_id, s1_id, p, round(smax, 6) AS sib_comb_smax, round(smean, 6) AS sib_comb_smean, round(swmax, 6) AS sib_comb_swmax, sib_n, {_context('r_id', 'smax')['others']} AS sib_comb_rival_max FROM s"""
    q["pct_rank_avg"] = "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_suppkey), 9) AS pct FROM lineitem"
    q["rerank_after_drop"] = f"WITH {_REC}, {_NAME5} SELECT j, i1, CAST(row_number() OVER (PARTITION BY j ORDER BY rk, i1) - 1 AS INT) AS rk FROM nr WHERE i1 NOT IN (SELECT id FROM rec WHERE name LIKE 'red %')"
    q["argmax_assign"] = f"WITH {_UNIQUE} SELECT r_id, s1_id, p FROM u QUALIFY {rank} = 1"
    q["poisson_binomial"] = f"WITH {_PAIRS}, g AS (SELECT s1_id, {_PMF.format(q='list(p / 3 ORDER BY p)')} AS d FROM pairs GROUP BY s1_id) SELECT s1_id, CAST(unnest(range(0, len(d))) AS INT) AS k, round(unnest(d), 9) AS chance FROM g"
    q["expected_f_select"] = f"""WITH {_UNIQUE}, l AS (SELECT s1_id, list(p ORDER BY p DESC, r_id) AS q FROM u GROUP BY s1_id),
k AS (SELECT s1_id, q, unnest(range(0, len(q) + 1)) AS k FROM l), d AS (SELECT s1_id, q, k, {_PMF.format(q='q[1:k]')} AS a, {_PMF.format(q='q[k + 1:]')} AS b FROM k),
e AS (SELECT s1_id, k, round(CASE WHEN k = 0 THEN b[1] ELSE list_sum(list_transform(range(1, k + 1), lambda s: a[s + 1] * list_sum(list_transform(range(0, len(b)), lambda t: b[t + 1] * 1.25 * s / (0.25 * (s + t) + k))))) END, 9) AS v FROM d)
SELECT s1_id, CAST(k AS INT) AS n_keep, v AS value FROM e QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY v DESC, k) = 1"""
    counts = "SELECT o_orderkey AS s1_id, coalesce(tp, 0) AS tp, coalesce(npred, 0) AS npred, coalesce(ntrue, 0) AS ntrue FROM orders LEFT JOIN (SELECT s1_id, count(*) FILTER (y) AS tp, count(*) AS npred FROM {p} GROUP BY s1_id) a ON a.s1_id = o_orderkey LEFT JOIN (SELECT s1_id, count(*) AS ntrue FROM u WHERE y GROUP BY s1_id) b ON b.s1_id = o_orderkey"
    q["macro_f05"] = f"WITH {_UNIQUE}, a AS (SELECT * FROM u QUALIFY {rank} = 1), c AS ({counts.format(p='a')}) SELECT round(avg({_F}), 9) AS macro_f FROM c"
    q["ceiling"] = f"WITH {_UNIQUE}, a AS (SELECT * FROM u WHERE p >= 0.3 AND y), c AS ({counts.format(p='a')}) SELECT round(avg({_F}), 9) AS macro_f FROM c"
    q["threshold_sweep"] = f"""WITH {_UNIQUE}, t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold), c AS (SELECT threshold, o_orderkey, coalesce(tp, 0) AS tp, coalesce(npred, 0) AS npred, coalesce(ntrue, 0) AS ntrue FROM orders CROSS JOIN t
LEFT JOIN (SELECT s1_id, threshold, count(*) FILTER (y) AS tp, count(*) AS npred FROM u JOIN t ON p >= threshold GROUP BY ALL) a ON a.s1_id = o_orderkey AND a.threshold = t.threshold LEFT JOIN (SELECT s1_id, count(*) AS ntrue FROM u WHERE y GROUP BY s1_id) b ON b.s1_id = o_orderkey) SELECT threshold, round(avg({_F}), 9) AS macro_f FROM c GROUP BY threshold""".replace("SELECT threshold, o_orderkey", "SELECT t.threshold, o_orderkey")
    q["empty_rate"] = f"WITH {_UNIQUE} SELECT o_orderpriority AS grp, round(avg(CASE WHEN EXISTS (SELECT 1 FROM u WHERE s1_id = o_orderkey AND p >= 0.5) THEN 0.0 ELSE 1.0 END), 9) AS empty_rate FROM orders GROUP BY ALL"
    q["odds_scale"] = f"WITH {_PAIRS} SELECT s1_id, ln, round(p * 0.4::DOUBLE / (p * 0.4::DOUBLE + 1 - p), 9) AS q FROM pairs"
    q["blend_mean"] = f"WITH {_PAIRS}, m AS (SELECT s1_id, ln, CASE WHEN p > 0.1 THEN p END AS a, CASE WHEN p2 > 0.3 THEN p2 END AS b FROM pairs) SELECT s1_id, ln, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 9) AS blend FROM m"
    subsets = [("p",), ("p2",), ("p3",), ("p", "p2"), ("p", "p3"), ("p2", "p3"), ("p", "p2", "p3")]
    q["blend_subsets"] = f"WITH {_PAIRS}, m AS (SELECT p, p2, qty / 50 AS p3, CAST(y AS INT) AS y FROM pairs) " + " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS models, round(sqrt(avg((({' + '.join(s)}) / {len(s)} - y) ** 2)), 9) AS rmse FROM m" for s in subsets)
    body = "CASE WHEN business_name LIKE '% fka %' THEN regexp_replace(split_part(business_name, ' fka ', 2), '\\(ID: [0-9]+\\)', ' ') ELSE regexp_replace(business_name, '\\(ID: [0-9]+\\)', ' ') END"
    core = f"list_filter(nf, lambda t: t NOT IN {_in(text.LEGAL + text.HONOR + text.STOP)})"
    q["norm_name"] = f"""WITH {_NAMED}, b AS (SELECT id, {body} AS c, CASE WHEN business_name LIKE '% fka %' THEN split_part(business_name, ' fka ', 1) ELSE '' END AS h FROM named), t AS (SELECT id, h, {_MARKED.format(c='c')} AS nf, list_transform(regexp_extract_all(lower(h), '[a-z0-9]+'), lambda t: {_case(text.NAME_CANON)}) AS na FROM b)
SELECT id, array_to_string(nf, ' ') AS nf, array_to_string(CASE WHEN len({core}) > 0 THEN {core} ELSE list_filter(nf, lambda t: t NOT IN {_in(text.LEGAL)}) END, ' ') AS nc, coalesce(array_to_string(list_filter(na, lambda t: t NOT IN {_in(text.LEGAL + text.HONOR + text.STOP)}), ' '), '') AS na, '' AS nw, coalesce(array_to_string(list_sort(list_distinct(list_filter(nf, lambda t: t IN {_in(text.LEGAL)}))), ' '), '') AS nl, CAST(CASE WHEN h <> '' THEN 1 ELSE 0 END AS SMALLINT) AS nflag FROM t"""
    q["norm_address"] = f"""WITH {_NAMED}, c AS (SELECT id, country, unnest(list_transform(string_split(lower(business_address), ','), lambda x: trim(x))) AS c, unnest(range(1, len(string_split(business_address, ',')) + 1)) AS k FROM named),
s AS (SELECT id, k, c, CASE WHEN {_case(_STATES, 'c')} <> c THEN {_case(_STATES, 'c')} WHEN country = 'US' AND c = 'tx' THEN 's_us_tx' WHEN country NOT IN ('US', 'India') AND c = 'tx' THEN 's_x_tx' END AS st FROM c WHERE c NOT IN {_in(text.EMPTY_COMPONENTS)}),
w AS (SELECT id, k, st, CASE WHEN st IS NOT NULL THEN [st] ELSE list_filter(list_transform(regexp_extract_all(regexp_replace(c, '\\b([0-9]+)(st|nd|rd|th)\\b', '\\1', 'g'), '[0-9]+|[a-z]+'), lambda t: {_ADDRESS_WORD}), lambda t: t NOT IN {_in(text.ADDRESS_DROP + text.LOCALITY_DROP)}) END AS ws FROM s)
SELECT id, array_to_string(flatten(list(ws ORDER BY k)), ' ') AS at, array_to_string(list_filter(flatten(list(ws ORDER BY k)), lambda t: regexp_full_match(t, '[0-9]+')), ' ') AS an, coalesce(first(st ORDER BY k) FILTER (st IS NOT NULL), '') AS ast, array_to_string(list(array_to_string(ws, ' ') ORDER BY k) FILTER (st IS NULL AND len(ws) > 0), '|') AS ac FROM w GROUP BY id"""
    host, ending = "regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '')", "'\\.(com|net|org|info|biz|co\\.in|in|fr|co|io|us)$'"
    stem = f"CASE WHEN regexp_matches({host}, {ending}) AND regexp_matches({host}, '^[\\pL\\pN]') THEN regexp_replace({host}, {ending}, '') END"
    q["norm_web"] = f"SELECT page_id, coalesce({stem}, '') AS stem, regexp_replace(translate(lower(coalesce({stem}, '')), '0134578@$', 'oleastbas'), '[^a-z0-9]', '', 'g') AS web FROM pages"
    q["ascii_fold"] = "SELECT doc_id, md5(lower(strip_accents(replace(text, 'ß', 'ss')))) AS folded_md5, CAST(length(strip_accents(replace(text, 'ß', 'ss'))) AS INT) AS n FROM documents"
    flag = lambda e: f"CAST(coalesce({e}, FALSE) AS INT)"
    q["fmt_features"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS n, coalesce(source, '') AS a FROM documents) SELECT doc_id, {flag("n = upper(n) AND regexp_matches(n, '[A-Za-z]')")} AS fm_name_upper, {flag("n = lower(n) AND regexp_matches(n, '[A-Za-z]')")} AS fm_name_lower, {flag("contains(n, '  ')")} AS fm_name_dbl, {flag("regexp_matches(n, '^[^\\pL\\pN_\\s]')")} AS fm_name_lead_punct, {flag("regexp_matches(n, '[^\\pL\\pN_\\s)\\].]$')")} AS fm_name_trail_punct, {flag("regexp_matches(n, '[\\[\\]()]')")} AS fm_name_brackets,
{flag("a = upper(a) AND a <> ''")} AS fm_addr_upper, {flag("a = ''")} AS fm_addr_empty, {flag("contains(a, '  ')")} AS fm_addr_dbl, {flag("regexp_matches(a, '(^|[ ,#])0[0-9]')")} AS fm_addr_lead0, {flag("contains(a, '#')")} AS fm_addr_hash, {flag("regexp_matches(lower(a), '\\bnull\\b|n/a|<null>')")} AS fm_addr_null, {flag("regexp_matches(lower(a), '\\b(po box|pmb)\\b')")} AS fm_addr_pobox, CAST(length(a) - length(replace(a, ',', '')) AS INT) AS fm_addr_ncomma, CAST(length(n) AS INT) AS fm_name_len, CAST(length(a) AS INT) AS fm_addr_len FROM d"""
    sig = "array_to_string(list_sort(regexp_extract_all({c}, '[,.&''()\\-/#\\[\\]|@*+]')), '')"
    one = "array_to_string(list_filter(string_split(lower({c}), ' '), lambda x: x <> ''), ' ')"
    q["raw_pair"] = f"""WITH {_PAIRED}, c AS (SELECT *, {_COMPS.format(c='a1')} AS ca, {_COMPS.format(c='a2')} AS cb, regexp_extract_all(n1, '{_TOK}') AS ta, regexp_extract_all(n2, '{_TOK}') AS tb FROM two), p AS (SELECT *, list_filter(list_transform(cb, lambda x: coalesce(list_position(ca, x), 0)), lambda i: i > 0) AS pos, lower(array_to_string(list_transform(ta, lambda t: t[1:1]), '')) AS ia, coalesce(lower(array_to_string(list_transform(list_filter(ta, lambda t: regexp_matches(t, '^[A-ZÀ-ÖØ-Þ]')), lambda t: t[1:1]), '')), '') AS ic, len(tb) = 1 AND length(tb[1]) BETWEEN 2 AND 6 AND regexp_full_match(tb[1], '[A-Za-zÀ-ÿ]+') AS short FROM c)
SELECT id, CAST({one.format(c='n1')} = {one.format(c='n2')} AS DOUBLE) AS rp_name_eq_ci, CASE WHEN a2 = '' THEN -1.0 ELSE CAST({one.format(c='a1')} = {one.format(c='a2')} AS DOUBLE) END AS rp_addr_eq_ci, CAST(n1 = n2 AS DOUBLE) AS rp_name_eq_cs, CAST({sig.format(c='n1')} = {sig.format(c='n2')} AS DOUBLE) AS rp_punct_eq, CAST(length(n2) - length(n1) AS DOUBLE) AS rp_name_dlen, CAST(length(a2) - length(a1) AS DOUBLE) AS rp_addr_dlen,
CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN -1.0 ELSE round(len(pos) / len(cb), 6) END AS rp_comp_share, {_RISE.format(p='pos')} AS rp_comp_order, CAST(CASE WHEN NOT short THEN 0 WHEN lower(tb[1]) IN (ia, ic) THEN 1 WHEN starts_with(ia, lower(tb[1])) OR starts_with(ic, lower(tb[1])) THEN 0.5 ELSE 0 END AS DOUBLE) AS rp_acronym, CAST(short AS DOUBLE) AS rp_short_name FROM p"""
    last = "lower(trim(string_split({c}, ' ')[-1], '()[]'))"
    q["raw_token"] = f"""WITH {_PAIRED}, c AS (SELECT *, {_COMPS.format(c='a1')} AS ca, {_COMPS.format(c='a2')} AS cb, regexp_extract_all(n1, '{_TOK}') AS ta, regexp_extract_all(n2, '{_TOK}') AS tb, {last.format(c='n1')} AS l1, {last.format(c='n2')} AS l2 FROM two), p AS (SELECT *, list_transform(ta, lambda t: lower(t)) AS la FROM c), r AS (SELECT *, list_filter(list_transform(tb, lambda t: coalesce(list_position(la, lower(t)), 0)), lambda i: i > 0) AS pos, list_filter(tb, lambda t: list_contains(la, lower(t))) AS met FROM p)
SELECT id, {_RISE.format(p='pos')} AS rt_tok_order, CASE WHEN len(met) = 0 THEN -1.0 ELSE round(len(list_filter(met, lambda t: list_reverse(ta)[list_position(list_reverse(la), lower(t))] = t)) / len(met), 6) END AS rt_case_same, CAST(coalesce(ta[1] = tb[1], FALSE) AS DOUBLE) AS rt_first_tok_eq, CASE WHEN l1 IN {_in(text.LEGAL)} AND l2 IN {_in(text.LEGAL)} THEN CAST(l1 = l2 AS DOUBLE) ELSE -1.0 END AS rt_legal_raw_eq, CAST(len(tb) - len(ta) AS DOUBLE) AS rt_ntok_diff, CAST(ca[1] = cb[1] AS DOUBLE) AS rt_addr_first_eq, CAST(ca[-1] = cb[-1] AS DOUBLE) AS rt_addr_last_eq, CAST(len(cb) - len(ca) AS DOUBLE) AS rt_ncomp_diff FROM r"""
    q["number_similarity"] = "WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS b FROM orders) SELECT o_orderkey, round(" + _SIM.format(x="a", y="b") + ", 6) AS s FROM o"
    q["num_features"] = f"""WITH {_NUMBERED} SELECT l_orderkey, CAST(a[1] = b[1] AS DOUBLE) AS num_first_eq, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS num_jac, CAST(len(list_intersect(a, b)) AS DOUBLE) AS num_inter, CAST(list_contains(b, a[1]) AS DOUBLE) AS num_f1_in2, CAST(list_contains(a, b[1]) AS DOUBLE) AS num_f2_in1, round({_SIM.format(x='a[1]', y='b[1]')}, 6) AS num_first_sim, round(greatest(0.0, list_max(flatten(list_transform(a[1:4], lambda x: list_transform(b[1:4], lambda y: {_SIM.format(x='x', y='y')}))))), 6) AS num_best_sim,
round(abs(CAST(a[1][1:9] AS BIGINT) - CAST(b[1][1:9] AS BIGINT)) / greatest(1, CAST(a[1][1:9] AS BIGINT), CAST(b[1][1:9] AS BIGINT)), 6) AS num_first_reldiff, CAST(list_contains(b, {_LONGEST}) AS DOUBLE) AS num_long_in2, CAST(len(a) AS INT) AS num_n1, CAST(len(b) AS INT) AS num_n2 FROM li"""
    rel = _relation("x", "y")
    q["number_relation"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({v} AS INT) AS \"{k}\"" for k, v in rel.items()) + " FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS x, CAST(l_suppkey AS VARCHAR) AS y FROM lineitem)"
    flags = ", ".join(f"CAST({v} AS INT) AS \"{k}\"" for k, v in rel.items())
    total = " + ".join(f'"{k}"' for k in rel)
    best = lambda p, n: f"{p}x AS (SELECT l_orderkey, {n} AS x, unnest(b[1:4]) AS y, unnest(range(1, len(b[1:4]) + 1)) AS i FROM li), {p} AS (SELECT * FROM (SELECT l_orderkey, i, {flags} FROM {p}x) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY \"eq\" DESC, {total} DESC, i) = 1)"
    q["number_relations"] = f"WITH {_NUMBERED}, {best('f', 'a[1]')}, {best('g', _LONGEST)} SELECT l_orderkey, " + ", ".join(f'f."{k}" AS nrf_{k}, g."{k}" AS nrl_{k}' for k in rel) + ", CAST(list_has_any(a, b) AS INT) AS num_any_shared, CAST(len(a) > 0 AND len(b) = 0 AS INT) AS rec_no_num FROM li JOIN f USING (l_orderkey) JOIN g USING (l_orderkey)"
    q["jaro_winkler"] = f"WITH {_PAIRED} SELECT id, round(jaro_winkler_similarity(n1, n2), 6) AS jw FROM two"
    q["token_difference"] = f"WITH {_PAIRED}, t AS (SELECT id, list_filter(list_distinct(string_split(n1, ' ')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split(n2, ' ')), lambda x: x <> '') AS b FROM two) SELECT id, coalesce(array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ' '), '') AS extra, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' '), '') AS missing FROM t"
    q["token_logodds"] = """WITH l AS (SELECT doc_id, quality = 1 AS y, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents JOIN labels USING (doc_id)), r AS (SELECT ln((count(*) FILTER (y) + 1) / (count(*) FILTER (NOT y) + 1)) AS prior FROM l),
t AS (SELECT token, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM (SELECT y, unnest(w) AS token FROM l) GROUP BY token HAVING count(*) >= 3)
SELECT 'word' AS kind, token, round(ln((p + 5 * exp(prior) / (1 + exp(prior))) / (n + 5 * (1 - exp(prior) / (1 + exp(prior))))) - prior, 6) AS lo FROM t, r"""
    w = _WORDS
    q["pseudo_logodds"] = f"""WITH {_PAIRED}, t AS (SELECT {w.format(c='n1')} AS c1, {w.format(c='n2')} AS c2, regexp_extract(a1, '[0-9]+') AS x, regexp_extract(a2, '[0-9]+') AS z, list_intersect({w.format(c='a1')}, {w.format(c='a2')}) AS s FROM two), k AS (SELECT * FROM t WHERE c1[1] = c2[1] AND x <> '' AND z <> '' AND len(s) >= 2),
d AS (SELECT 'extra' AS kind, x = z AS y, unnest(list_filter(list_distinct(c2), lambda v: NOT list_contains(c1, v))) AS token FROM k UNION ALL SELECT 'missing', x = z, unnest(list_filter(list_distinct(c1), lambda v: NOT list_contains(c2, v))) FROM k)
SELECT kind, token, round(ln((count(*) FILTER (y) + 1) / (count(*) FILTER (NOT y) + 1)), 6) AS lo FROM d GROUP BY ALL"""
    q["learn_token_map"] = f"""WITH {_PAIRED}, t AS (SELECT {w.format(c='n2')} AS b, {w.format(c='n1')} AS a FROM two), z AS (SELECT unnest(b) AS token, unnest(a) AS aligned FROM t WHERE len(a) = len(b)), c AS (SELECT token, aligned, count(*) AS n FROM z GROUP BY ALL)
SELECT token, aligned, n FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, aligned) AS rk, sum(n) OVER (PARTITION BY token) AS s FROM c) WHERE rk = 1 AND n >= 2 AND n / s >= 0.3"""
    comps = "list_transform(string_split(lower({c}), ','), lambda x: trim(x))"
    q["learn_components"] = f"""WITH {_PAIRED}, t AS (SELECT id, unnest({comps.format(c='a2')}) AS token, list_distinct({comps.format(c='a1')}) AS e FROM two), seen AS (SELECT token, count(*) AS seen FROM t GROUP BY token), c AS (SELECT token, aligned, count(*) AS n FROM (SELECT token, unnest(e) AS aligned FROM t) GROUP BY ALL)
SELECT token, aligned, n FROM (SELECT c.*, seen, row_number() OVER (PARTITION BY token ORDER BY n DESC, aligned) AS rk FROM c JOIN seen USING (token)) WHERE rk = 1 AND n >= 3 AND n / seen >= 0.3"""
    q["record_knn"] = f"WITH {_REC}, " + _NEAR.format(g=_ADDR_GRAMS, r="rec", m=0.3) + " SELECT grp, j, nb, sim FROM near"
    q["neighbour_consensus"] = _MET + """, i AS (SELECT id, string_split(addr, ' ')[1] AS num, string_split(name, ' ')[2] AS core FROM rec),
m AS (SELECT p.j, p.i1, sim, CAST(n.num = r.num AS INT) AS nr, CAST(n.num = e.num AS INT) AS na, CAST(n.core = r.core AS INT) AS cr, CAST(n.core = e.core AS INT) AS ca, CAST(sim >= 0.4 AS INT) AS h FROM p JOIN near ON near.j = p.j JOIN i n ON n.id = nb JOIN i r ON r.id = p.j JOIN i e ON e.id = p.i1),
g AS (SELECT p.j, p.i1, count(h) AS nb_n, CAST(coalesce(sum(h), 0) AS BIGINT) AS nb_hi, coalesce(sum(nr), 0) AS nr, coalesce(sum(na), 0) AS na, coalesce(sum(cr), 0) AS cr, coalesce(sum(ca), 0) AS ca, CAST(coalesce(sum(nr * h), 0) AS BIGINT) AS nb_hi_num_eq_r, CAST(coalesce(sum(na * h), 0) AS BIGINT) AS nb_hi_num_eq_a, CAST(coalesce(sum(cr * h), 0) AS BIGINT) AS nb_hi_core_eq_r, CAST(coalesce(sum(ca * h), 0) AS BIGINT) AS nb_hi_core_eq_a FROM p LEFT JOIN m ON m.j = p.j AND m.i1 = p.i1 GROUP BY ALL)
SELECT g.j, g.i1, nb_n, nb_hi, nb_hi_num_eq_r, nb_hi_num_eq_a, nb_hi_core_eq_r, nb_hi_core_eq_a, round(nr / (nb_n + 1e-6), 6) AS nb_num_eq_r, round(na / (nb_n + 1e-6), 6) AS nb_num_eq_a, round((na - nr) / (nb_n + 1e-6), 6) AS nb_num_dir, round(cr / (nb_n + 1e-6), 6) AS nb_core_eq_r, round(ca / (nb_n + 1e-6), 6) AS nb_core_eq_a, round((ca - cr) / (nb_n + 1e-6), 6) AS nb_core_dir, CAST(r.num = e.num AS INT) AS r_num_eq_a FROM g JOIN i r ON r.id = g.j JOIN i e ON e.id = g.i1"""
    q["neighbour_votes"] = _MET + """, best AS (SELECT j AS nb, i1 AS bi, p AS bp FROM p QUALIFY row_number() OVER (PARTITION BY j ORDER BY p DESC, i1) = 1),
m AS (SELECT p.j, p.i1, sim, coalesce(bi = p.i1, FALSE) AS s, coalesce(bi <> p.i1, FALSE) AS o, coalesce(bp, 0.0) AS bp FROM p JOIN near ON near.j = p.j LEFT JOIN best USING (nb)),
g AS (SELECT p.j, p.i1, p.p, coalesce(sum(sim), 0.0) AS w, coalesce(sum(sim * bp) FILTER (s), 0.0) AS va, coalesce(sum(sim * bp) FILTER (o), 0.0) AS vo, CAST(count(*) FILTER (s) AS DOUBLE) AS nv_cnt_a, CAST(count(*) FILTER (o) AS DOUBLE) AS nv_cnt_other, coalesce(max(bp) FILTER (s), 0.0) AS nv_pmax_a, coalesce(max(bp) FILTER (o), 0.0) AS nv_pmax_other FROM p LEFT JOIN m ON m.j = p.j AND m.i1 = p.i1 GROUP BY ALL)
SELECT j, i1, p, nv_cnt_a, nv_cnt_other, nv_pmax_a, nv_pmax_other, round(va / (w + 1e-6), 6) AS nv_vote_a, round(vo / (w + 1e-6), 6) AS nv_vote_other, round((va - vo) / (w + 1e-6), 6) AS nv_margin FROM g"""
    q["write_lists"] = f"WITH {_UNIQUE}, l AS (SELECT s1_id, string_agg(CAST(r_id AS VARCHAR), ',' ORDER BY CAST(r_id AS VARCHAR)) AS m FROM u WHERE p >= 0.5 GROUP BY s1_id) SELECT o_orderkey AS s1_id, coalesce(m, '') AS matched_ids FROM orders LEFT JOIN l ON s1_id = o_orderkey"
    q["error_breakdown"] = f"WITH {_UNIQUE} SELECT src3 AS grp, CASE WHEN p >= 0.5 AND y THEN 'hit' WHEN p >= 0.5 THEN 'false' ELSE 'missed' END AS kind, count(*) AS n FROM u WHERE p >= 0.5 OR y GROUP BY ALL"
    q["group_rates"] = f"WITH {_UNIQUE} SELECT src3, count(*) AS n, count(*) FILTER (y) AS positive, round(avg(p), 6) AS mean_p, count(DISTINCT r_id) AS records FROM u GROUP BY src3"
    q["scores_by_group"] = f"WITH {_UNIQUE}, a AS (SELECT * FROM u WHERE p >= 0.5), c AS ({counts.format(p='a')}) SELECT o_orderpriority AS grp, count(*) AS n, round(avg({_F}), 9) AS macro_f FROM c JOIN orders ON o_orderkey = s1_id GROUP BY ALL"
    q["group_logodds"] = """WITH t AS (SELECT lang AS "group", quality, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS token FROM documents JOIN labels USING (doc_id)),
a AS (SELECT token, round(ln((count(*) FILTER (quality = 1) + 1) / (count(*) FILTER (quality <> 1) + 1)), 6) AS lo FROM t GROUP BY token),
g AS (SELECT "group", token, count(*) AS n, round(ln((count(*) FILTER (quality = 1) + 1) / (count(*) FILTER (quality <> 1) + 1)), 6) AS own FROM t GROUP BY ALL)
SELECT "group", token, CASE WHEN n >= 20 THEN own ELSE lo END AS lo FROM g JOIN a USING (token)"""
    draw = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
    q["shift_context"] = f"WITH {_UNIQUE}, k AS (SELECT r_id, s1_id, p FROM u WHERE NOT {draw('CAST(s1_id AS VARCHAR)')} < 0.18 * 4294967296) SELECT r_id, s1_id, p, {jp['gap']} AS cos_rmax_gap, {jp['rank']} AS cos_rrank, {jp['second']} AS cos_r2nd, {ip['gap']} AS cos_s1max_gap, {ip['rank']} AS cos_s1rank, count(*) OVER (PARTITION BY r_id) AS r_ncand, count(*) OVER (PARTITION BY s1_id) AS s1_ncand FROM k"
    q["easy_negatives"] = f"WITH {_UNIQUE} SELECT r_id, s1_id, p, y, CASE WHEN y OR p >= 0.5 THEN 1.0 ELSE 1 / 0.3 END AS weight FROM u WHERE y OR p >= 0.5 OR {draw("r_id || '|' || s1_id")} < 0.3 * 4294967296"
    q["threshold_decision"] = f"WITH {_UNIQUE}, a AS (SELECT r_id, s1_id, p FROM u QUALIFY {rank} = 1) SELECT * FROM a WHERE p >= 0.5"

    def chosen(score: str) -> str:
        """Tables ending in a: each record's best entity of u by `score`, as many an entity as maximise expected F."""
        return f"""b AS (SELECT r_id, s1_id, y, {score} AS q FROM u QUALIFY row_number() OVER (PARTITION BY r_id ORDER BY q DESC, s1_id) = 1), l AS (SELECT s1_id, list(q ORDER BY q DESC, r_id) AS q FROM b GROUP BY s1_id),
k AS (SELECT s1_id, q, unnest(range(0, len(q) + 1)) AS k FROM l), d AS (SELECT s1_id, q, k, {_PMF.format(q='q[1:k]')} AS a, {_PMF.format(q='q[k + 1:]')} AS b FROM k),
e AS (SELECT s1_id, k, round(CASE WHEN k = 0 THEN b[1] ELSE list_sum(list_transform(range(1, k + 1), lambda s: a[s + 1] * list_sum(list_transform(range(0, len(b)), lambda t: b[t + 1] * 1.25 * s / (0.25 * (s + t) + k))))) END, 9) AS v FROM d QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY v DESC, k) = 1),
a AS (SELECT b.* FROM b JOIN e USING (s1_id) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY q DESC, r_id) <= k)"""

    q["expected_f_decision"] = f"WITH {_UNIQUE}, {chosen('p')} SELECT r_id, s1_id, q AS p FROM a"
    macro = "SELECT '{name}' AS {kind}, (WITH {sets}, c AS ({counts}) SELECT round(avg({f}), 9) FROM c) AS macro_f"
    by = lambda kind, name, sets: macro.format(kind=kind, name=name, sets=sets, counts=counts.format(p="a"), f=_F)
    level = lambda t: f"a AS (SELECT * FROM (SELECT * FROM u QUALIFY {rank} = 1) WHERE p >= {t})"
    q["rules_compared"] = f"WITH {_UNIQUE} " + " UNION ALL ".join([by("rule", f"threshold {t}", level(t)) for t in (0.3, 0.5)] + [by("rule", f"expected f, odds {m}", chosen(f"round(p * {m}::DOUBLE / (p * {m}::DOUBLE + 1 - p), 9)")) for m in (1.0, 0.4)])
    present = "list_avg(list_filter([{}], lambda x: x IS NOT NULL))"
    model = {"p": "p", "p2": "CASE WHEN p2 > 0.3 THEN p2 END", "p3": "round(qty / 51, 4)"}
    q["blends_compared"] = f"WITH {_UNIQUE} " + " UNION ALL ".join(by("models", "+".join(c), chosen(f"round({present.format(', '.join(f'CAST({model[m]} AS DOUBLE)' for m in c))}, 9)")) for c in (("p",), ("p", "p2"), ("p", "p3"), ("p", "p2", "p3")))
    q["prior_match"] = f"""WITH RECURSIVE {_UNIQUE}, held AS (SELECT o_orderkey, coalesce(max(p), 0.0) AS best FROM orders LEFT JOIN u ON s1_id = o_orderkey GROUP BY o_orderkey),
b AS (SELECT 0 AS step, 0.05::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL SELECT step + 1, CASE WHEN share > 0.6 THEN mid ELSE lo END, CASE WHEN share > 0.6 THEN hi ELSE mid END FROM (SELECT step, lo, hi, sqrt(lo * hi) AS mid, (SELECT avg(CASE WHEN best * sqrt(lo * hi) / (best * sqrt(lo * hi) + 1 - best) < 0.5 THEN 1.0 ELSE 0.0 END) FROM held) AS share FROM b WHERE step < 12))
SELECT CASE WHEN (SELECT avg(CASE WHEN best < 0.5 THEN 1.0 ELSE 0.0 END) FROM held) >= 0.6 THEN 1.0 ELSE round(sqrt(lo * hi), 9) END AS m FROM b WHERE step = 12"""
    q["error_examples"] = f"""WITH {_UNIQUE}, real AS (SELECT r_id, min(s1_id) AS s1_id FROM u WHERE y GROUP BY r_id), sel AS (SELECT * FROM u WHERE p >= 0.5), x AS (SELECT 'false' AS kind, sel.s1_id, sel.r_id, real.s1_id AS true_entity FROM sel LEFT JOIN real USING (r_id) WHERE real.s1_id IS DISTINCT FROM sel.s1_id
UNION ALL SELECT 'missed', real.s1_id, real.r_id, real.s1_id FROM real ANTI JOIN sel USING (s1_id, r_id))
SELECT kind, x.s1_id, x.r_id, CASE WHEN p >= 0.1 THEN p END AS score, true_entity, coalesce(p >= 0.1, FALSE) AS in_candidates FROM x LEFT JOIN u USING (s1_id, r_id) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {draw("x.s1_id || '|' || x.r_id")}, x.s1_id, x.r_id) <= 20"""
    q["top_tokens"] = f"SELECT * FROM (SELECT kind, token, lo, CAST(row_number() OVER (PARTITION BY kind ORDER BY lo, token) AS INT) AS from_least, CAST(row_number() OVER (PARTITION BY kind ORDER BY lo DESC, token) AS INT) AS from_largest FROM ({q['token_logodds']})) WHERE from_least <= 10 OR from_largest <= 10"
    q["unseen_groups"] = "SELECT DISTINCT split_part(p_name, ' ', 1) AS grp FROM part WHERE split_part(p_name, ' ', 1) NOT IN (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 40 = 0)"
    apart = lambda a, b: f"list_filter(list_distinct(string_split(lower({a}), ' ')), lambda x: x <> '' AND NOT list_contains(string_split(lower({b}), ' '), x))"
    q["log_odds_features"] = f"""WITH {_PAIRED}, t AS (SELECT id, id % 3 = 0 AS y, {apart('n2', 'n1')} AS extra, {apart('n1', 'n2')} AS missing FROM two), r AS (SELECT ln((count(*) FILTER (y) + 1) / (count(*) FILTER (NOT y) + 1)) AS prior FROM t),
x AS (SELECT id, y, 'extra' AS kind, unnest(extra) AS token FROM t UNION ALL SELECT id, y, 'missing', unnest(missing) FROM t), n AS (SELECT kind, token, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM x GROUP BY ALL HAVING count(*) >= 3),
lo AS (SELECT kind, token, round(ln((p + 5 * exp(prior) / (1 + exp(prior))) / (n + 5 * (1 - exp(prior) / (1 + exp(prior))))) - prior, 6) AS lo FROM n, r), z AS (SELECT id, kind, coalesce(lo, 0.0) AS lo FROM x LEFT JOIN lo USING (kind, token))
SELECT t.id, """ + ", ".join(f"coalesce({f}(lo) FILTER (kind = '{k}'), 0.0) AS {c}_lo_{f}" for k, c in (("extra", "xe"), ("missing", "xm")) for f in ("min", "max")) + ", " + ", ".join(f"round(coalesce(sum(lo) FILTER (kind = '{k}'), 0.0), 6) AS {c}_lo_sum, count(*) FILTER (kind = '{k}') AS {c}_n" for k, c in (("extra", "xe"), ("missing", "xm"))) + " FROM t LEFT JOIN z USING (id) GROUP BY t.id"
    q["key_channel_best"] = f"WITH {_REC}, {_KEYS}, {_vectors('n', _NAME_GRAMS, 2)}, kc AS (SELECT kp.grp, kp.j, kp.i1, coalesce((SELECT round(sum(x.w * y.w), 6) FROM nv x JOIN nv y USING (f) WHERE x.id = kp.j AND y.id = kp.i1), 0.0) AS cos FROM kp) SELECT * FROM (SELECT grp, j, i1, cos, CAST(row_number() OVER (PARTITION BY grp, j ORDER BY cos DESC, i1) - 1 AS INT) AS rk FROM kc WHERE cos >= 0.3) WHERE rk < 2"
    # what the marks leave of a name is known from how they were put there
    words = "lower(p_name)"
    q["norm_name_marks"] = f"SELECT p_partkey, CASE p_size % 8 WHEN 2 THEN 'abc ' || {words} WHEN 3 THEN 'ms ' || {words} WHEN 6 THEN 'dillii ' || {words} WHEN 7 THEN 'cafe ' || {words} ELSE {words} END AS nf, CASE p_size % 8 WHEN 2 THEN 'abc ' || {words} WHEN 6 THEN 'dillii ' || {words} WHEN 7 THEN 'cafe ' || {words} ELSE {words} END AS nc, '' AS na, CASE WHEN p_size % 8 = 1 THEN 'acme' ELSE '' END AS nw, '' AS nl, CAST(CASE p_size % 8 WHEN 1 THEN 8 WHEN 5 THEN 16 WHEN 6 THEN 4 ELSE 0 END AS SMALLINT) AS nflag FROM part"
    q["norm_address_marks"] = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size || ' rue zola lyon s_fr_bre' WHEN 1 THEN p_size || ' zola marg s_in_mh' WHEN 2 THEN p_size || ' s_in_wb' WHEN 3 THEN p_size || ' zola s_in_mh' WHEN 4 THEN p_size || ' dillii' ELSE p_size || ' zola s_us_or' END AS at, CAST(p_size AS VARCHAR) AS an,
CASE p_size % 6 WHEN 0 THEN 's_fr_bre' WHEN 1 THEN 's_in_mh' WHEN 2 THEN 's_in_wb' WHEN 3 THEN 's_in_mh' WHEN 4 THEN '' ELSE 's_us_or' END AS ast, CASE p_size % 6 WHEN 0 THEN p_size || ' rue zola|lyon' WHEN 1 THEN p_size || ' zola marg' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN p_size || ' zola' WHEN 4 THEN p_size || '|dillii' ELSE p_size || ' zola' END AS ac, p_size % 6 = 4 AS aind FROM part"""
    q["score_correlation"] = f"WITH {_PAIRS} SELECT src3, round(corr(p, qty), 6) AS r FROM pairs GROUP BY src3"
    return q


ORACLES = _made()
