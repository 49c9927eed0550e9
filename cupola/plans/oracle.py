"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from cupola.functions.columns import TOKEN
from cupola.plans import queries as Q
from cupola.plans.surrogates import ARRIVALS, AUTHORS, ITEMS, RX, SEED

_T = TOKEN.replace("'", "''")


def in_set(code: str, codes: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce({code} = '{c}' OR {code} LIKE '{c}.%', false)" for c in codes) + ")"


def md5(key: str, seed: int, salt: str = "") -> str:
    return f"md5({key} || ':{seed}{':' + salt if salt else ''}')"


def fill_sql(rows: str, spec: list, seed: int, p: str = "") -> str:
    """CTEs {p}docs, {p}lev (level, base, stop, target) and {p}out (key, doc, level, split) for the rows (key, doc)."""
    ctes = [f"{p}docs AS (SELECT doc, count(*) AS cnt, CAST(sum(count(*)) OVER (ORDER BY {md5('doc', seed, 'doc')}, doc) AS BIGINT) AS cum FROM {rows} WHERE doc IS NOT NULL GROUP BY doc)"]
    base = "0"
    for k, level in enumerate(spec):
        t = sum(n for _, n in level)
        ctes.append(
            f"{p}l{k} AS (SELECT {k} AS level, b AS base, coalesce((SELECT coalesce(min(cum) FILTER (WHERE cum - b >= {t}), max(cum)) FROM {p}docs WHERE cum > b), b) AS stop, {t} AS target FROM (SELECT {base} AS b))"
        )
        base = f"(SELECT stop FROM {p}l{k})"
    ctes.append(f"{p}lev AS (" + " UNION ALL ".join(f"SELECT * FROM {p}l{k}" for k in range(len(spec))) + ")")
    values = ", ".join(f"({k}, '{name}', {sum(n for _, n in level[:j])}, {size})" for k, level in enumerate(spec) for j, (name, size) in enumerate(level))
    ctes.append(f"{p}sets AS (SELECT * FROM (VALUES {values}) AS v(level, split, start, size))")
    ctes.append(
        f"""{p}placed AS (
  SELECT r.key, r.doc, l.level FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {md5('key', seed)}, key) - 1 AS i FROM {rows} WHERE doc IS NOT NULL) r
  JOIN {p}docs d ON d.doc = r.doc JOIN {p}lev l ON d.cum > l.base AND d.cum <= l.stop WHERE d.cum - d.cnt - l.base + r.i < l.target)"""
    )
    ctes.append(f"{p}num AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {md5('key', seed, 'level')}, key) AS rn FROM {p}placed)")
    ctes.append(f"{p}out AS (SELECT n.key, n.doc, n.level, s.split FROM {p}num n JOIN {p}sets s ON s.level = n.level AND n.rn > s.start AND n.rn <= s.start + s.size)")
    return ",\n".join(ctes)




_SIDES = f"WITH {ITEMS}"
_KEY = "r || '>>' || p"
_EXPORT_ITEMS = f"""num AS (SELECT rid, smi, lft, row_number() OVER (PARTITION BY rid, lft ORDER BY smi) - 1 AS i FROM items),
ks AS (SELECT rid, {_KEY} AS key FROM sides),
ord AS (SELECT num.*, key, md5(smi || ':' || i || ':' || key || ':{SEED}') AS h FROM num JOIN ks USING (rid)),
ex AS (SELECT rid, coalesce(string_agg(smi, '.' ORDER BY h, smi) FILTER (WHERE lft), '') AS er, coalesce(string_agg(smi, '.' ORDER BY h, smi) FILTER (WHERE NOT lft), '') AS ep FROM ord GROUP BY rid)"""
_MOL = "repeat('C', CAST(1 + p_size % 7 AS INTEGER)) || CASE WHEN p_partkey % 3 = 0 THEN '(=O)O' WHEN p_partkey % 3 = 1 THEN 'c1ccccc1Cl' ELSE '[N+](=O)[O-]' END"
# per molecule: heavy atoms, bonds, carbon, all known from how it is made
_MEASURES = f"""mol AS (
  SELECT p_partkey, {_MOL} AS smiles, 1 + p_size % 7 + CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 7 ELSE 3 END AS heavy,
    p_size % 7 + CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 8 ELSE 3 END AS bonds FROM part)"""
_CHECKED = f"""{_MEASURES},
it AS (SELECT l_orderkey AS rid, smiles, heavy, bonds, l_linenumber <= 3 AS lft FROM lineitem JOIN mol ON l_partkey = p_partkey),
agg AS (
  SELECT rid, coalesce(sum(heavy) FILTER (WHERE lft), 0) AS heavy, count(*) FILTER (WHERE lft) AS n_left, max(bonds) FILTER (WHERE lft) AS bonds,
    len(regexp_extract_all(coalesce(string_agg(smiles, '.') FILTER (WHERE lft), ''), '{_T}')) AS tl, len(regexp_extract_all(coalesce(string_agg(smiles, '.') FILTER (WHERE NOT lft), ''), '{_T}')) AS tr,
    list(DISTINCT smiles) FILTER (WHERE lft) AS ls, list(DISTINCT smiles) FILTER (WHERE NOT lft) AS rs
  FROM it GROUP BY rid),
chk AS (
  SELECT rid, CASE WHEN heavy < 5 THEN 'at_least_5_heavy_atoms_in_reactants' WHEN n_left = 0 THEN 'at_least_one_carbon_in_reactants'
    WHEN NOT (tl < 40 AND tr < 40) THEN 'under_800_tokens' WHEN bonds < 2 THEN 'at_least_two_bonds_in_one_molecule'
    WHEN len(list_filter(coalesce(rs, []), lambda x: NOT list_contains(coalesce(ls, []), x))) = 0 THEN 'at_least_one_larger_product_different' END AS first_failure FROM agg)"""
_FOLD = """list_reduce(es, lambda c, n: CASE WHEN (n.named AND NOT c.named) OR c.year IS NULL OR coalesce(n.year < c.year, false) THEN n ELSE c END)"""


def fold_sql(rows: str) -> str:
    return f"es AS (SELECT dkey, list(struct_pack(ord := ord, named := name IS NOT NULL, year := year) ORDER BY ord) AS es FROM {rows} GROUP BY dkey), fold AS (SELECT dkey, {_FOLD}.ord AS ord FROM es)"


_C = Q.CLASSES
_POOLS = f"""known AS (SELECT * FROM rx WHERE name_rxn IS NOT NULL AND name_rxn <> '0.0'),
od AS (SELECT * FROM known WHERE {in_set('name_rxn', Q.CODES)}),
free AS (SELECT * FROM known WHERE NOT {in_set('name_rxn', Q.CODES)} AND doc IS NOT NULL AND doc NOT IN (SELECT doc FROM od WHERE doc IS NOT NULL))"""
# the class sets' sizes are far below what the tables hold, so no level is cut short
_CLASSES = f"""{RX}, {_POOLS},
{fill_sql('od', [[('ft', _C['finetune'])], [('od_test', _C['od_test'])]], SEED, 'a')},
{fill_sql('free', [[('valid', _C['valid'])], [('id_test', _C['id_test'])], [('train', _C['train_limit'])]], SEED + 1, 'b')},
cls AS (SELECT o.key, o.doc, o.split, rx.name_rxn FROM (SELECT * FROM aout UNION ALL SELECT * FROM bout) o JOIN rx USING (key))"""
_SIZES = f"""sz AS (SELECT year, n, test, CAST(trunc((n - test) * (1 - {Q.VALID_PROPORTION}::DOUBLE)) AS BIGINT) AS train, n - test - CAST(trunc((n - test) * (1 - {Q.VALID_PROPORTION}::DOUBLE)) AS BIGINT) AS valid
  FROM (SELECT year, count(*) AS n, CAST(CASE WHEN count(*) > {2 * Q.TEST_AMOUNT} THEN {Q.TEST_AMOUNT} ELSE 0 END AS BIGINT) AS test FROM rx WHERE year IS NOT NULL AND year >= 1900 GROUP BY year))"""


def years_sql() -> str:
    """CTE yr (key, year, split): levels test, valid, train inside every year; a year without a test set begins with valid."""
    docs = f"yd AS (SELECT year, doc, count(*) AS cnt, CAST(sum(count(*)) OVER (PARTITION BY year ORDER BY {md5('doc', SEED, 'doc')}, doc) AS BIGINT) AS cum FROM rx WHERE doc IS NOT NULL AND year IS NOT NULL AND year >= 1900 GROUP BY year, doc)"
    ctes, base = [docs], "SELECT year, 0 AS b, test, valid, train FROM sz"
    for k, name in enumerate(("test", "valid", "train")):
        ctes.append(
            f"""y{k} AS (
  SELECT q.year, q.b AS base, CASE WHEN '{name}' = 'test' AND q.test = 0 THEN q.b ELSE coalesce(coalesce(min(cum) FILTER (WHERE cum - q.b >= q.{name}), max(cum)), q.b) END AS stop, q.{name} AS target, '{name}' AS split, q.test, q.valid, q.train
  FROM ({base}) q LEFT JOIN yd ON yd.year = q.year AND yd.cum > q.b GROUP BY q.year, q.b, q.test, q.valid, q.train)"""
        )
        base = f"SELECT year, stop AS b, test, valid, train FROM y{k}"
    ctes.append("yl AS (SELECT year, base, stop, target, split FROM y0 UNION ALL SELECT year, base, stop, target, split FROM y1 UNION ALL SELECT year, base, stop, target, split FROM y2)")
    ctes.append(
        f"""yr AS (
  SELECT r.key, r.year, l.split FROM (SELECT *, row_number() OVER (PARTITION BY year, doc ORDER BY {md5('key', SEED)}, key) - 1 AS i FROM rx WHERE doc IS NOT NULL) r
  JOIN yd d ON d.year = r.year AND d.doc = r.doc JOIN yl l ON l.year = r.year AND d.cum > l.base AND d.cum <= l.stop WHERE d.cum - d.cnt - l.base + r.i < l.target)"""
    )
    return ",\n".join(ctes)


_YEARS = f"WITH {RX}, {_SIZES}, {years_sql()}"
_CUTS = "(SELECT unnest([" + ", ".join(map(str, Q.CUTOFFS)) + "])::INTEGER AS cutoff)"
_AUTHOR_BASE = f"""{RX}, {AUTHORS},
ka AS (SELECT * FROM rx WHERE doc IS NOT NULL AND rid IN (SELECT rid FROM au)),
pairs AS (SELECT DISTINCT lower(trim(author)) AS author, doc FROM ka JOIN au USING (rid)),
ranks AS (SELECT author, row_number() OVER (ORDER BY {md5('author', SEED, 'author')}, author) AS author_rank FROM (SELECT DISTINCT author FROM pairs)),
claims AS (SELECT doc, min(author_rank) AS author_rank FROM pairs JOIN ranks USING (author) GROUP BY doc)"""


def author_levels_sql(over: int) -> str:
    ctes = ["ac AS (SELECT author_rank, CAST(sum(count(*)) OVER (ORDER BY author_rank) AS BIGINT) AS cum FROM claims JOIN ka USING (doc) GROUP BY author_rank)"]
    after, base = "0", "0"
    for k, level in enumerate(Q.AUTHOR_SPEC):
        t = sum(n for inner in level for _, n in inner) + over
        ctes.append(f"al{k} AS (SELECT min(author_rank) AS r, min(cum) AS c FROM ac WHERE cum - {base} >= {t})")
        ctes.append(f"pool{k} AS (SELECT ka.* FROM ka JOIN claims USING (doc) WHERE author_rank > {after} AND author_rank <= (SELECT r FROM al{k}))")
        ctes.append(fill_sql(f"pool{k}", level, SEED + k, f"p{k}"))
        after, base = f"(SELECT r FROM al{k})", f"(SELECT c FROM al{k})"
    return ",\n".join(ctes)


_EXCLUDED = "(SELECT key FROM rx WHERE rid % 2 = 0 UNION SELECT key FROM rx WHERE year < 1998)"

ORACLE_SQL = {
    "hier_class_filter": f"WITH {RX} SELECT key, name_rxn FROM rx WHERE {in_set('name_rxn', Q.CODES)}",
    "core_title": f"WITH {RX} SELECT key, split_part(title, '_', 1) AS core FROM rx",
    "date_parts": """WITH d AS (SELECT o_orderkey, substr(strftime(o_orderdate, '%Y%m%d'), 1, CAST(2 * (o_orderkey % 5) AS INTEGER)) AS d FROM orders)
SELECT o_orderkey, CASE WHEN length(d) >= 4 THEN CAST(CAST(d[1:4] AS INTEGER) AS VARCHAR) END AS year, CASE WHEN length(d) >= 6 THEN CAST(CAST(d[5:6] AS INTEGER) AS VARCHAR) END AS month, CASE WHEN length(d) > 6 THEN CAST(CAST(d[7:] AS INTEGER) AS VARCHAR) END AS day FROM d""",
    "json_extract_default": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.absent'), 'unk') AS absent FROM events",
    "cast_unknown": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (2, 3) THEN CAST(o_custkey AS VARCHAR) END AS v FROM orders",
    "multiset_key": f"{_SIDES} SELECT rid, {_KEY} AS key FROM sides",
    "multiset_expand": f"{_SIDES} SELECT rid, smi, CAST(count(*) AS INTEGER) AS n FROM items WHERE lft GROUP BY rid, smi",
    "multiset_rest": f"{_SIDES} SELECT rid, smi, CAST(sum(CASE WHEN lft THEN 1 ELSE -1 END) AS INTEGER) AS n FROM items GROUP BY rid, smi HAVING sum(CASE WHEN lft THEN 1 ELSE -1 END) > 0",
    "jsonl_export": f"""{_SIDES}, {_EXPORT_ITEMS} SELECT rid, '{{"translation":{{"reactants":"' || er || '","products":"' || ep || '"}}}}' AS line FROM ex""",
    "jsonl_roundtrip": f"{_SIDES} SELECT rid, {_KEY} AS back, true AS same FROM sides",
    "tokenize_count": f"""WITH s AS (SELECT 'p' || p_partkey AS id, {_MOL} AS smiles FROM part UNION ALL SELECT 'd' || doc_id, text FROM documents),
t AS (SELECT id, smiles, regexp_extract_all(smiles, '{_T}') AS ts FROM s)
SELECT id, CAST(len(ts) AS BIGINT) AS n_tokens, array_to_string(ts, '') = smiles AS round_trip FROM t""",
    "token_limit_filter": f"SELECT p_partkey, {_MOL} AS smiles FROM part WHERE len(regexp_extract_all({_MOL}, '{_T}')) < 9",
    "first_failure_counts": f"""WITH {_CHECKED},
names AS (SELECT unnest(['at_least_5_heavy_atoms_in_reactants', 'at_least_one_carbon_in_reactants', 'under_800_tokens', 'at_least_two_bonds_in_one_molecule', 'at_least_one_larger_product_different', 'not_deprotonation']) AS first_failure)
SELECT first_failure, count(rid) AS n FROM names LEFT JOIN chk USING (first_failure) GROUP BY first_failure""",
    "first_failure_detail": f"WITH {_CHECKED} SELECT rid, first_failure FROM chk WHERE first_failure IS NOT NULL",
    "dedup_displacement": f"WITH {RX}, {ITEMS}, {ARRIVALS}, a AS (SELECT ord, dkey, name_rxn AS name, year FROM arr), {fold_sql('a')} SELECT fold.dkey, fold.ord, name_rxn, CAST(year AS VARCHAR) AS year FROM fold JOIN arr USING (ord)",
    "dup_count": f"WITH {RX}, {ITEMS}, {ARRIVALS} SELECT count(*) AS n_rows, count(DISTINCT dkey) AS n_keys, count(*) - count(DISTINCT dkey) AS n_duplicates FROM arr",
    "year_histogram": f"WITH {RX} SELECT year, count(*) AS n FROM rx WHERE year >= 1900 GROUP BY year",
    "provenance_histogram": f"WITH {RX}, {ITEMS}, {ARRIVALS} SELECT dkey, 'year' AS kind, CAST(year AS VARCHAR) AS value, count(*) AS n FROM arr GROUP BY dkey, year UNION ALL SELECT dkey, 'name_rxn', name_rxn, count(*) FROM arr GROUP BY dkey, name_rxn",
    "seeded_topk": f"WITH {RX} SELECT * FROM (SELECT year, key, row_number() OVER (PARTITION BY year ORDER BY {md5('key', SEED)}, key) AS rn FROM rx WHERE year IS NOT NULL) WHERE rn <= 50",
    "seeded_permutation": f"WITH {RX} SELECT key, row_number() OVER (ORDER BY {md5('key', SEED)}, key) AS rank FROM rx",
    "doc_quota_fill": f"WITH {RX}, {fill_sql('rx', Q.SPEC, SEED)} SELECT key, doc, level, split FROM out",
    "doc_quota_meta": f"""WITH {RX}, {fill_sql('rx', Q.SPEC, SEED)}
SELECT level, CAST(target AS BIGINT) AS target, CAST(least(target, stop - base) AS BIGINT) AS n_rows, (SELECT count(*) FROM docs WHERE cum <= stop) AS n_docs_used, (SELECT count(*) FROM docs) AS n_docs_total FROM lev""",
    "level_slices": f"WITH {RX}, {fill_sql('rx', Q.SPEC, SEED)} SELECT level, split, count(*) AS n, count(DISTINCT doc) AS n_docs FROM out GROUP BY level, split",
    "author_first_claim": f"WITH {_AUTHOR_BASE} SELECT doc, author_rank FROM claims",
    "author_doc_split": f"WITH {_AUTHOR_BASE}, {author_levels_sql(20)} SELECT key, doc, 0 AS author_level, split FROM p0out UNION ALL SELECT key, doc, 1, split FROM p1out",
    "namerxn_split": f"WITH {_CLASSES} SELECT key, doc, name_rxn, split FROM cls",
    "class_counts_by_split": f"WITH {_CLASSES} SELECT split, name_rxn, count(*) AS n FROM cls GROUP BY split, name_rxn",
    "id_doc_antijoin": f"WITH {RX}, {_POOLS} SELECT key, doc FROM free",
    "term_warnings": " UNION ALL ".join(
        f"SELECT DISTINCT p_name AS name_rxn_def, p_brand AS name_rxn, '{'+'.join(g)}' AS term_group FROM part WHERE " + " AND ".join(f"regexp_matches(p_name, '(?i){t}')" for t in g) for g in Q.TERMS
    ),
    "time_split_sizes": f"WITH {RX}, {_SIZES} SELECT year, n, test, train, valid FROM sz",
    "time_split_assign": f"{_YEARS} SELECT key, year, split FROM yr",
    "time_split_plain": f"""WITH {RX}, {_SIZES} SELECT key, r.year, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + valid THEN 'valid' ELSE 'test' END AS split
FROM (SELECT key, year, row_number() OVER (PARTITION BY year ORDER BY {md5('key', SEED)}, key) AS rn FROM rx WHERE year >= 1900) r JOIN sz USING (year)""",
    "time_set_sizes": f"{_YEARS} SELECT year, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test FROM yr GROUP BY year",
    "cutoff_training_sets": f"""{_YEARS},
w AS (SELECT cutoff, split, key, row_number() OVER (PARTITION BY cutoff, split ORDER BY md5(key || ':{SEED}:' || cutoff), key) AS rn FROM yr JOIN {_CUTS} ON year <= cutoff WHERE split <> 'test')
SELECT cutoff, split, key FROM w WHERE rn <= CASE WHEN split = 'valid' THEN {Q.MOST_VALID} ELSE least({Q.MOST_TRAIN}, (SELECT count(*) FROM yr WHERE split = 'train' AND year <= {min(Q.CUTOFFS)})) END""",
    "train_size_control": f"{_YEARS} SELECT cutoff, count(*) AS possible, greatest(count(*) - {Q.MOST_TRAIN}, 0) AS excluded FROM yr JOIN {_CUTS} ON year <= cutoff WHERE split = 'train' GROUP BY cutoff",
    "bespoke_filtered": f"WITH {RX} SELECT key, name_rxn FROM rx WHERE {in_set('name_rxn', Q.CODES)} AND key NOT IN {_EXCLUDED}",
    "bespoke_overlap_report": f"""WITH {RX}, c AS (SELECT * FROM rx WHERE {in_set('name_rxn', Q.CODES)})
SELECT 'even' AS dataset, count(*) AS n_overlap FROM c WHERE rid % 2 = 0 UNION ALL SELECT 'old', count(*) FROM c WHERE year < 1998""",
    "bespoke_referential_check": f"WITH {RX} SELECT DISTINCT CAST(l_orderkey + l_linenumber AS VARCHAR) AS key FROM lineitem WHERE CAST(l_orderkey + l_linenumber AS VARCHAR) NOT IN (SELECT key FROM rx)",
    "audit_pairwise_overlap": f"""WITH {RX}, s AS (SELECT DISTINCT doc, 's' || (CAST('0x' || substr({md5('key', SEED)}, 1, 8) AS BIGINT) % 3) AS split FROM rx WHERE doc IS NOT NULL)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM s a JOIN s b ON a.doc = b.doc AND a.split < b.split GROUP BY a.split, b.split""",
    "audit_author_containment": f"""WITH {_AUTHOR_BASE}, {author_levels_sql(20)}, s AS (SELECT key, split FROM p0out UNION ALL SELECT key, split FROM p1out),
sa AS (SELECT DISTINCT s.key, s.split, lower(trim(author)) AS author FROM s JOIN rx USING (key) JOIN au USING (rid)),
tr AS (SELECT DISTINCT author FROM sa WHERE split = 'train')
SELECT key, count(*) AS n_authors, count(tr.author) AS n_seen, count(*) = count(tr.author) AS covered FROM sa LEFT JOIN tr USING (author) WHERE split IN ('author_od_test', 'doc_od_test') GROUP BY key""",
    "audit_doc_positive_control": f"WITH {_CLASSES} SELECT count(*) AS n_shared FROM (SELECT doc FROM cls WHERE split IN ('train', 'id_test') GROUP BY doc HAVING count(DISTINCT split) > 1)",
    "audit_class_overlap": f"WITH {_CLASSES} SELECT count(*) AS n_shared FROM (SELECT name_rxn FROM cls GROUP BY name_rxn HAVING count(DISTINCT split IN ('ft', 'od_test')) > 1)",
    "audit_keys_disjoint": f"WITH {_CLASSES} SELECT (SELECT count(*) FROM (SELECT key FROM cls GROUP BY key HAVING count(DISTINCT split) > 1)) AS n_shared, (SELECT count(*) FROM (SELECT split, key FROM cls GROUP BY split, key HAVING count(*) > 1)) AS n_repeats",
    "audit_jurisdiction": f"WITH {RX} SELECT substr(doc, 1, 2) AS jurisdiction, count(DISTINCT doc) AS n_docs FROM rx WHERE doc IS NOT NULL GROUP BY 1",
    "audit_document_years": f"WITH {RX} SELECT doc, count(DISTINCT year) AS n_years FROM rx WHERE doc IS NOT NULL GROUP BY doc HAVING count(DISTINCT year) > 1",
    "changed_bonds_fullouter": """WITH s AS (SELECT l_orderkey AS rid, least(l_partkey % 10, l_suppkey % 10) AS a, greatest(l_partkey % 10, l_suppkey % 10) AS b, CAST(l_linenumber % 3 + 1 AS DOUBLE) AS ord, l_linenumber % 2 = 1 AS before FROM lineitem),
w AS (SELECT rid, a, b, max(ord) AS ord FROM s WHERE before GROUP BY rid, a, b), n AS (SELECT rid, a, b, max(ord) AS ord FROM s WHERE NOT before GROUP BY rid, a, b),
j AS (SELECT coalesce(w.rid, n.rid) AS rid, coalesce(w.a, n.a) AS a, coalesce(w.b, n.b) AS b, w.ord AS was, n.ord AS now FROM w FULL OUTER JOIN n ON w.rid = n.rid AND w.a = n.a AND w.b = n.b)
SELECT rid, a, b, coalesce(now, 0.0::DOUBLE) AS ord FROM j WHERE was IS DISTINCT FROM now AND EXISTS (SELECT 1 FROM n WHERE n.rid = j.rid AND (n.a IN (j.a, j.b) OR n.b IN (j.a, j.b)))""",
    # by how the reactions are made: k carbons, and what each kind does to them
    "changed_bonds_text": """WITH p AS (SELECT p_partkey, CAST(2 + p_size % 7 AS INTEGER) AS k, p_partkey % 6 AS v FROM part),
x AS (
  SELECT p_partkey, k AS a, 90 AS b, 0.0::DOUBLE AS ord FROM p WHERE v = 0 UNION ALL SELECT p_partkey, k, 92, 1.0::DOUBLE FROM p WHERE v = 0
  UNION ALL SELECT p_partkey, 31, 32, 1.0::DOUBLE FROM p WHERE v = 1
  UNION ALL SELECT p_partkey, 50, 90, 0.0::DOUBLE FROM p WHERE v = 2 UNION ALL SELECT p_partkey, 1, 50, 1.0::DOUBLE FROM p WHERE v = 2
  UNION ALL SELECT p_partkey, 66, 90, 0.0::DOUBLE FROM p WHERE v = 3 UNION ALL SELECT p_partkey, 66, 95, 1.0::DOUBLE FROM p WHERE v = 3
  UNION ALL SELECT p_partkey, 50, 90, 2.0::DOUBLE FROM p WHERE v = 5)
SELECT p_partkey, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, ord FROM x""",
    "reagent_split": """WITH p AS (
  SELECT p_partkey, p_partkey % 6 AS v, '[cH:61]1[cH:62][cH:63][cH:64][cH:65][c:66]1' AS z,
    array_to_string(list_transform(range(1, CAST(3 + p_size % 7 AS INTEGER)), lambda i: '[CH2:' || i || ']'), '') AS c
  FROM part)
SELECT p_partkey,
  CASE v WHEN 0 THEN c || '[Cl:90].[CH3:91][NH2:92]' WHEN 1 THEN '[CH2:31]=[CH:32]' || c || '[CH3:60]' WHEN 2 THEN c || '[CH2:50][Br:90]' WHEN 3 THEN z || '[Cl:90].[OH2:95]' WHEN 4 THEN 'O' ELSE c || '[CH2:50][OH:90]' END AS reactants,
  CASE v WHEN 0 THEN 'CCO.[OH2:99]' WHEN 1 THEN '[HH]' WHEN 2 THEN '' WHEN 3 THEN '[Na+].[OH-].' || c WHEN 4 THEN '[OH:90]' || c || '[CH3:60].O' ELSE 'O.OCC' END AS reagents,
  CASE v WHEN 0 THEN c || '[NH:92][CH3:91]' WHEN 1 THEN '[CH3:31][CH2:32]' || c || '[CH3:60]' WHEN 2 THEN replace(c, '[CH2:1]', '[CH2:1]%12') || '[CH2:50]%12.[BrH:90]' WHEN 3 THEN z || '[OH:95]' WHEN 4 THEN '' ELSE c || '[CH:50]=[O:90].O' END AS products
FROM p""",
    "neutral_pairs": "SELECT p_partkey, false AS same, p_partkey % 5 IN (0, 1, 3) AS same_neutral FROM part",
    "canonical_spellings": """WITH p AS (
  SELECT p_partkey, p_partkey % 4 = 3 AS acid, p_size % 7 AS k,
    CASE p_partkey % 4 WHEN 0 THEN repeat('C', CAST(1 + p_size % 7 AS INTEGER)) || 'O' WHEN 1 THEN 'O' || repeat('C', CAST(1 + p_size % 7 AS INTEGER)) WHEN 2 THEN 'C(O)' || repeat('C', CAST(p_size % 7 AS INTEGER))
      ELSE 'N[C@@H](' || repeat('C', CAST(1 + p_size % 7 AS INTEGER)) || ')C(=O)O' END AS smi
  FROM part)
SELECT p_partkey, smi, first_value(smi) OVER (PARTITION BY acid, k ORDER BY length(smi), smi) AS form, count(*) OVER (PARTITION BY smi) AS n FROM p""",
    "atom_map_numbers": "SELECT p_partkey, p_size || ',' || (p_partkey % 7) AS maps FROM part",
    "molecule_measures": f"WITH {_MEASURES} SELECT p_partkey, heavy, true AS carbon, bonds FROM mol",
    "fp_sum": "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(sum(CAST(round(CAST(embedding[pos] AS DOUBLE), 6) * 1000000 AS BIGINT)) AS DOUBLE) / 1000000, 4) AS total FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY label, pos",
    "sha256_manifest": f"""WITH {_CLASSES}, h AS (SELECT split, sha256(key || '|' || name_rxn) AS h FROM cls),
a AS (SELECT split, substr(h, 1, 5) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY split, substr(h, 1, 5)),
b AS (SELECT split, substr(p, 1, 2) AS q, sum(n) AS n, sha256(string_agg(d, '' ORDER BY p)) AS d FROM a GROUP BY split, substr(p, 1, 2))
SELECT split, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY q)) AS sha256 FROM b GROUP BY split""",
    "time_split_shortfalls": f"{_YEARS} SELECT year, split, CAST(target AS BIGINT) AS target, CAST(least(target, stop - base) AS BIGINT) AS n_rows, CAST(target - least(target, stop - base) AS BIGINT) AS short FROM yl WHERE NOT (split = 'test' AND target = 0)",
    "unknown_counts": f"""WITH {RX}, {AUTHORS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE title IS NULL) AS unknown_titles, count(*) FILTER (WHERE rid NOT IN (SELECT rid FROM au)) AS unknown_authors,
  count(DISTINCT doc) AS n_docs, (SELECT count(DISTINCT lower(trim(author))) FROM au WHERE rid IN (SELECT rid FROM rx)) AS n_authors FROM rx""",
    # by how it is made: only these ends leave a readable molecule, and a text of words is none
    "unreadable_filter": f"""SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % {len(Q.SPOILT)} NOT IN (0, 1, 5, 7, 10, 11)
UNION ALL SELECT 'd' || doc_id FROM documents""",
    "rxn_dedup_text": f"""WITH d AS (SELECT doc_id AS ord, md5(text) AS dkey, CASE WHEN source <> 'src0' THEN lang END AS name, CASE WHEN doc_id % 9 <> 0 THEN CAST(n_chars % 50 AS INTEGER) END AS year FROM documents), {fold_sql('d')}
SELECT dkey, ord FROM fold""",
}
