"""DuckDB SQL that gives the rows of the queries SQL can express."""

from __future__ import annotations


def secret_scan() -> str:
    """Spans of every rule by full scans of every text, from matches and the gaps between them."""
    from .secret_scan import BASE_RULES, RULES

    def either(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    pattern = {r.kind: r.pattern for r in RULES}
    pattern["assign"] = f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    ctes = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"]
    for n, r in enumerate(RULES):
        p = pattern[r.kind]
        ctes.append(
            f"m{n} AS (SELECT r, regexp_extract_all(t, '{p}', 0) AS w, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g FROM d),\n"
            f"p{n} AS (SELECT r, i, {n} AS k, '{r.kind}' AS kind, length(w[i]) AS size, length(v[i]) AS value, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS start FROM (SELECT r, w, v, g, unnest(range(1, len(w) + 1)) AS i FROM m{n}))"
        )
    rows = " UNION ALL ".join(f"SELECT r, k, kind, start, start + size AS finish FROM p{n} WHERE value >= {r.least}" for n, r in enumerate(RULES))
    base = len(BASE_RULES)
    counts = ", ".join(f"count(s.k) FILTER (s.k = {n}) AS n_{r.kind}" for n, r in enumerate(BASE_RULES))
    one = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(finish AS BIGINT)"
    return (
        "WITH " + ",\n".join(ctes) + f",\ns AS ({rows})\n"
        f"SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY start, k) FILTER (s.k < {base}), '')) AS base_sha256, "
        f"coalesce(string_agg({one}, ',' ORDER BY start, k), '') AS spans FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r"
    )


def chat_format() -> str:
    """Digests from the rows themselves; lengths from the escapes that each text needs; the turn order as a regular expression over role letters."""
    from .chat import TEMPLATE

    def escaped(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in TEMPLATE.controls:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    fixed = len(TEMPLATE.start) + len(TEMPLATE.message) + len(TEMPLATE.end)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns,
  coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss,
  sum({fixed} + length({escaped('role')}) + length({escaped('text')})) AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' {order}) AS letters
  FROM c GROUP BY conv_id),
r AS (SELECT *, length(regexp_extract(letters, '^(s?(ua)*u?|s)')) AS good FROM g)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  regexp_full_match(letters, 's?(ua)+') AS valid, CASE WHEN good < n_turns THEN good END AS broken_at FROM r"""


def mixing(targets: dict, share: float, documents: str = "documents", name: str = "mix") -> str:
    """Raking as one chain of window sums, of as many sweeps as there may be."""
    from .mixing import DRAW_BITS, MAX_SWEEPS

    words = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
    drawn = f"({share!r}::DOUBLE * (SELECT sum(tokens) FROM c))"
    ctes = [
        f"d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS source, coalesce(CAST(lang AS VARCHAR), '') AS lang, {words} AS tokens, "
        "CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[#$%&*!]{2}') THEN 'noise' WHEN length(coalesce(text, '')) < 600 THEN 'note' ELSE 'prose' END AS topic "
        f"FROM {documents})",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, target in targets.items():
        now = f"(SELECT {dim}, sum(tokens) AS tokens FROM c GROUP BY {dim} HAVING sum(tokens) > 0)"
        if isinstance(target, dict):
            known = "CASE " + dim + " " + " ".join(f"WHEN '{v}' THEN {float(s)!r}::DOUBLE" for v, s in target.items()) + " END"
            left = max(0.0, 1.0 - sum(target.values()))
            raw = f"SELECT {dim}, tokens, coalesce({known}, tokens / sum(CASE WHEN {known} IS NULL THEN tokens ELSE 0 END) OVER () * {left!r}::DOUBLE) AS raw FROM {now}"
        else:
            raw = f"SELECT {dim}, tokens, pow(tokens, {float(target)!r}::DOUBLE) AS raw FROM {now}"
        # a value gives what it has at most; the others rise to the highest level that is reached as values run out
        ctes += [
            f"s_{dim} AS MATERIALIZED (SELECT {dim}, tokens, raw / sum(raw) OVER () AS share FROM ({raw}))",
            f"l_{dim} AS MATERIALIZED (SELECT *, ({drawn} - coalesce(sum(tokens) OVER (ORDER BY tokens / share, {dim} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
            f"/ sum(share) OVER (ORDER BY tokens / share, {dim} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s_{dim} WHERE share > 0)",
            f"t_{dim} AS MATERIALIZED (SELECT {dim}, least(tokens, share * (SELECT max(level) FROM l_{dim})) AS mass FROM l_{dim})",
        ]
    joined = " ".join(f"LEFT JOIN t_{d} USING ({d})" for d in targets)
    ctes.append(f"r0 AS MATERIALIZED (SELECT c.*, {', '.join(f't_{d}.mass AS mass_{d}' for d in targets)}, {share!r}::DOUBLE AS p FROM c {joined})")
    n = 0
    for _ in range(MAX_SWEEPS):
        for d in targets:
            n += 1
            sums = f"sum(p * tokens) OVER (PARTITION BY {d}) AS n, sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) OVER (PARTITION BY {d}) AS f"
            ctes.append(
                f"r{n} AS MATERIALIZED (SELECT * EXCLUDE (n, f) REPLACE (CASE WHEN mass_{d} IS NULL OR n <= 0 THEN p WHEN n > mass_{d} THEN p * mass_{d} / n WHEN p < 1 AND n > f THEN least(1.0, p * (mass_{d} - f) / (n - f)) ELSE p END AS p) "
                f"FROM (SELECT *, {sums} FROM r{n - 1}))"
            )
    ctes.append(f"p AS (SELECT source, lang, topic, round(p, 9) AS expected FROM r{n})")
    draw = f"CAST('0x' || substr(md5('{name}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DRAW_BITS // 4}) AS BIGINT) / {float(1 << DRAW_BITS)!r}::DOUBLE"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT d.doc_id, d.source, d.lang, d.topic, d.tokens AS n_tokens, round(p.expected / {share!r}::DOUBLE, 6) AS weight, round(p.expected, 6) AS probability, "
        f"{draw} < p.expected AS sampled FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"
    )
