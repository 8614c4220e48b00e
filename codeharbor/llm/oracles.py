"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from codeharbor.llm.common import LOWER, UPPER
from codeharbor.llm.decontaminate import WINDOW
from codeharbor.llm.url_filter import LISTED_SITES, RULES

_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM items)),
docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
grams AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g FROM (
  SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT DISTINCT r, s, n, item_id FROM grams JOIN windows USING (n, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN named USING (r)
"""

_FITS = {site + start: f"((host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{start}'))" for site, start, _ in RULES}
_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_RULE = "CASE " + " ".join(f"WHEN {_FITS[s + p]} THEN '{s + p}'" for s, p, _ in _LONGEST) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {_FITS[s + p]} THEN '{v}'" for s, p, v in _LONGEST) + " END"

URL_FILTER = rf"""
WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM rests),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') AS site,
  array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)')), '&') AS kept FROM parts),
canon AS (SELECT *, CASE WHEN site <> '' THEN site || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url FROM named),
listed AS (SELECT DISTINCT url FROM canon WHERE regexp_matches(host, '(^|\.)({'|'.join(LISTED_SITES)})(\.|$)') AND url IS NOT NULL)
SELECT page_id, host, path, {_RULE} AS rule,
  coalesce({_VERDICT}, CASE WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM canon
"""

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _head(first: str, last: str) -> str:
    return f"array_to_string(list_slice(u, {first}, {last}), '')"


FILL_IN_MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{_TOKEN}') AS u, {', '.join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {_head('1', 'a')} AS x, {_head('a + 1', 'b')} AS y, {_head('b + 1', 'n')} AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _merkle(depth: int) -> str:
    """SQL for trees of at most 16 ** depth nodes: every level as a table of nodes, then one fold per row and level."""
    value = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    rest = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # crc32 bit by bit over the key's decimal digits
    step = "xor(c, CASE WHEN i % 8 = 0 THEN unicode(substr(k, (i // 8)::INT + 1, 1)) ELSE 0 END)"
    bits = f"list_reduce([4294967295] || range(8 * length(k)), lambda c, i: xor(({step}) >> 1, (({step}) & 1) * 3988292384))"
    made = [f"""docs AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS k, sha256({rest} || {value('text')}) AS leaf,
  sha256({rest} || {value(f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered FROM documents),
marked AS (SELECT *, xor(4294967295, {bits}) % 5 = 0 AS hit FROM docs),
rows0 AS (SELECT doc_id, source AS g, leaf, CASE WHEN hit THEN lowered ELSE leaf END AS f,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM marked),
n0 AS (SELECT g, i, leaf AS d FROM rows0)"""]

    def raised(name: str, level: int, by: str) -> str:
        below, above = f"{name}{level}", f"{name}{level + 1}"
        return f"""{above}runs AS (SELECT {by}, i // 16 AS p, list(d ORDER BY i) AS ds, any_value(size) AS size
  FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS size FROM {below}) GROUP BY {by}, i // 16),
{above} AS (SELECT {by}, p AS i, CASE WHEN size = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {above}runs)"""

    made += [raised("n", k, "g") for k in range(depth)]
    made.append(f"tops AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j FROM n{depth})")
    made.append("m0 AS (SELECT 0 AS z, j AS i, subroot AS d FROM tops)")
    made += [raised("m", k, "z") for k in range(depth)]
    made.append("f0 AS (SELECT r, g, i, f, '' AS proof FROM rows0)")

    def folded(step: int, runs: str, on: str) -> str:
        left, right = "array_to_string(list_slice(ds, 1, (i % 16)::INT), '')", "array_to_string(list_slice(ds, (i % 16)::INT + 2, 16), '')"
        return f"""f{step + 1} AS (SELECT r, f{step}.g, i // 16 AS i, CASE WHEN size = 1 THEN f ELSE sha256({left} || f || {right}) END AS f,
  CASE WHEN size = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM f{step} JOIN {runs} ON {on} AND i // 16 = p)"""

    made += [folded(k, f"n{k + 1}runs", f"f{k}.g IS NOT DISTINCT FROM n{k + 1}runs.g") for k in range(depth)]
    made.append(f"f{depth + 1} AS (SELECT r, f{depth}.g, j AS i, f, proof FROM f{depth} JOIN tops ON f{depth}.g IS NOT DISTINCT FROM tops.g)")
    made += [folded(depth + 1 + k, f"m{k + 1}runs", "z = 0") for k in range(depth)]
    last = f"f{2 * depth + 1}"
    return "WITH " + ",\n".join(made) + f"""
SELECT doc_id, leaf, subroot, m{depth}.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m{depth}.d AS verified
FROM rows0 JOIN (SELECT r, f AS folded, proof FROM {last}) USING (r) JOIN tops ON rows0.g IS NOT DISTINCT FROM tops.g CROSS JOIN m{depth}
"""


MERKLE_MANIFEST = _merkle(4)

ORACLE = {"op4_decontamination": DECONTAMINATION, "op8_url_filter": URL_FILTER, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_merkle_manifest": MERKLE_MANIFEST}
