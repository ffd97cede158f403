"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

REST = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), {REST}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), {REST}, 2)"


def _node(url: str) -> str:
    slash = f"CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END"
    return f"CASE WHEN {_host(url)} <> '' THEN concat({_host(url)}, {slash}, regexp_extract({url}, '(?s)^[^#?]*(\\?[^#]*)', 1)) END"


def _tags(tag: str, kind: str, value: str) -> str:
    found = f"list_filter(regexp_extract_all(coalesce(html, ''), '{tag}'), lambda t: regexp_matches(t, '{kind}'))"
    return f"list_filter(list_transform({found}, lambda t: regexp_extract(t, '{value}', 1)), lambda v: v <> '')"


CANONICAL = _tags(
    r"(?is)<link\b[^>]*>", r"(?is)\brel\s*=\s*[\"'']?canonical\b", r"(?is)\bhref\s*=\s*[\"'']?([^\"''\s>]+)"
)
REFRESH = _tags(
    r"(?is)<meta\b[^>]*>", r"(?is)\bhttp-equiv\s*=\s*[\"'']?refresh\b", r"(?is)\burl\s*=\s*[\"'']?([^\"''\s>;]+)"
)


def _rule(rules: list[tuple[str, str, str]], host: str, path: str, what: str) -> str:
    """The longest fitting rule's text or verdict."""
    cases = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1]) - len(r[2])):
        fits = f"({host} = '{rule_host}' OR ends_with({host}, '.{rule_host}')) AND starts_with({path}, '{rule_path}')"
        cases.append(f"WHEN {fits} THEN '{rule_host + rule_path if what == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} END"


def urls_sql(rules: list[tuple[str, str, str]]) -> str:
    """Verdicts by rules, else by the pages reachable over redirects and canonical links in either direction."""
    scheme = "coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'http')"
    base = f"concat({scheme}, '://', {_host('url')})"
    own_path = _path("url")
    folder = f"regexp_replace(CASE WHEN {own_path} = '' THEN '/' ELSE {own_path} END, '[^/]*$', '')"
    return f"""WITH RECURSIVE
l AS (SELECT url, unnest(list_concat({CANONICAL}, {REFRESH})) AS link FROM pages WHERE {_host('url')} <> ''),
f AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN concat({scheme}, ':', link) WHEN starts_with(link, '/') THEN concat({base}, link)
    WHEN regexp_matches(link, '^[#?]') THEN concat({base}, {own_path}, link) ELSE concat({base}, {folder}, link) END AS target FROM l),
e AS (SELECT DISTINCT {_node('url')} AS a, {_node('target')} AS b FROM f),
e2 AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a AS node, b AS other FROM e2 UNION SELECT r.node, e2.b FROM reach r JOIN e2 ON e2.a = r.other),
n AS (SELECT node, split_part(other, '/', 1) AS h, regexp_extract(other, '(?s)^[^/]*([^?]*)', 1) AS p FROM reach),
v AS (SELECT node, MIN({_rule(rules, 'h', 'p', 'verdict')}) AS alias_verdict FROM n GROUP BY 1),
j AS (SELECT page_id, {_host('url')} AS host, {own_path} AS path, {_node('url')} AS node FROM pages)
SELECT page_id, host, path, {_rule(rules, 'host', 'path', 'rule')} AS rule,
  coalesce({_rule(rules, 'host', 'path', 'verdict')}, alias_verdict, 'allow') AS verdict
FROM j LEFT JOIN v ON v.node = j.node"""


def merkle_sql(fan: int = 3, leaf_levels: int = 10, group_levels: int = 5) -> str:
    """The manifest level by level; ``fan ** levels`` bounds the leaves of a source and the sources."""

    def leaf(text: str) -> str:
        fields = [f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}::VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")]
        return f"sha256(concat({', '.join(fields)}, CASE WHEN {text} IS NULL THEN '-' ELSE concat(strlen({text}), ':', {text}) END))"

    # CRC-32 of the id's digits, bit by bit
    crc = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"""
    steps = [
        f"""docs AS (SELECT *, concat(CASE WHEN source IS NULL THEN '0' ELSE '1' END, source) AS src, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS changed FROM documents)""",
        """path0 AS MATERIALIZED (SELECT doc_id, src, leaf, changed AS fold, '' AS proof,
  row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs)""",
        "level0 AS MATERIALIZED (SELECT src, pos, leaf AS h, count(*) OVER (PARTITION BY src) AS n FROM path0)",
    ]

    def climb(first: int, count: int, group: str) -> None:
        """Runs, next level and longer paths, count times; group: the columns that name a tree."""
        name = f"{group}, " if group else ""
        for k in range(first, first + count):
            on = "r.src = p.src AND " if group else ""
            beside = f"list_concat(r.hs[1:p.pos % {fan}], r.hs[p.pos % {fan} + 2:])"
            fold = f"sha256(concat(array_to_string(r.hs[1:p.pos % {fan}], ''), p.fold, array_to_string(r.hs[p.pos % {fan} + 2:], '')))"
            steps.append(
                f"""runs{k} AS MATERIALIZED (SELECT {name}pos // {fan} AS run, list(h ORDER BY pos) AS hs, max(n) AS n
  FROM level{k} GROUP BY {name}pos // {fan})"""
            )
            steps.append(
                f"""level{k + 1} AS MATERIALIZED (SELECT {name}run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h,
  (n + {fan - 1}) // {fan} AS n FROM runs{k})"""
            )
            steps.append(
                f"""path{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN r.n > 1 THEN {fold} ELSE p.fold END AS fold,
  CASE WHEN r.n > 1 THEN concat(p.proof, array_to_string({beside}, '')) ELSE p.proof END AS proof, p.pos // {fan} AS pos)
  FROM path{k} p JOIN runs{k} r ON {on}r.run = p.pos // {fan})"""
            )

    climb(0, leaf_levels, "src")
    k = leaf_levels + 1
    steps.append(f"tops AS MATERIALIZED (SELECT src, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS place FROM level{leaf_levels})")
    steps.append(
        f"""path{k} AS MATERIALIZED (SELECT p.* REPLACE (t.place AS pos), t.subroot FROM path{leaf_levels} p JOIN tops t ON t.src = p.src)"""
    )
    steps.append(f"level{k} AS MATERIALIZED (SELECT place AS pos, subroot AS h, count(*) OVER () AS n FROM tops)")
    climb(k, group_levels, "")
    last = k + group_levels
    return f"""WITH {', '.join(steps)}
SELECT doc_id, leaf, subroot, (SELECT h FROM level{last}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = (SELECT h FROM level{last}) AS verified FROM path{last}"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Product codes with every entry compared in every round."""
    squared = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
  list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v
  FROM kept, range({parts}) t(p))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM cut WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT a.r, a.p, min({squared} * {entries} + b.e) AS best
  FROM cut a JOIN book{k} b ON a.p = b.p GROUP BY a.r, a.p)"""
        )
        if k < rounds:
            steps.append(
                f"""mean{k} AS MATERIALIZED (SELECT p, e, list(x ORDER BY i) AS v FROM (
  SELECT n.p, n.best % {entries} AS e, i, floor(sum(c.v[i])::DOUBLE / count(*))::BIGINT AS x
  FROM near{k} n JOIN cut c ON c.r = n.r AND c.p = n.p, range(1, len(c.v) + 1) t(i) GROUP BY n.p, n.best % {entries}, i) GROUP BY p, e)"""
            )
            steps.append(
                f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)"
            )
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS digest FROM book{rounds})")
    steps.append(
        f"""coded AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY p) AS code,
  sum(best // {entries})::BIGINT AS error FROM near{rounds} GROUP BY r)"""
    )
    return f"""WITH {', '.join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT digest FROM books) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""
