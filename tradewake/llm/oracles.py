"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tradewake.llm import collocations
from tradewake.llm.chat import CONTROLS, MARKS
from tradewake.llm.quality_rules import (
    CORE,
    CUT,
    FALL,
    FIRST_CORE,
    FIRST_STEPS,
    LEAST,
    MOST,
    STARTS,
    SYMBOLS,
    VECTOR,
    P,
    consistency,
)
from tradewake.llm.sharding import DIGITS, SHARDS

_BLANKS = r"[\x20\x09-\x0D]+"

# The UTF-8 bytes of a text run through the bitwise CRC-32 step by step.
_CRC = """
    list_reduce(
      list_prepend(4294967295, list_transform(range(octet_length(encode(coalesce(text, '')))),
        lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))
"""

_SHARD = f"""
    SELECT r, arg_min(s, -ln((('0x' || substr(md5(key || ':' || s), 1, {DIGITS}))::BIGINT + 0.5)
           / {16**DIGITS}.0)) AS shard
    FROM d, range({{n}}) AS t(s) GROUP BY r
"""

OP1 = f"""
WITH steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
    SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id::VARCHAR, '') AS key,
           hex(encode(coalesce(text, ''))) AS digits
    FROM documents
), sums AS (
    SELECT r, doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size,
           xor({_CRC}, 4294967295)::BIGINT AS text_crc32
    FROM d, steps
), now AS ({_SHARD.format(n=SHARDS)}), grown AS ({_SHARD.format(n=SHARDS + 1)})
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY now.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown.shard::INTEGER AS grown_shard
FROM sums JOIN now USING (r) JOIN grown USING (r)
"""

OP3 = f"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{_BLANKS}'), lambda x: x <> '') AS words
    FROM documents
), s AS (
    SELECT r, doc_id, list_distinct(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))
    END) AS shingles
    FROM w
), e AS (
    SELECT r, doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM e AS a JOIN e AS b USING (shingle)
    WHERE a.r <> b.r
    GROUP BY a.r, b.r, a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN component ON s.doc_id = component.a
"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _escaped(control: str) -> str:
    return "".join(f"\\{c}" if c in "[]|" else c for c in control)


_CONTROL = "|".join(f"{_escaped(c[0])}\\\\*{_escaped(c[1:])}" for c in CONTROLS)
_WRITTEN = f"(length({{0}}) + len(regexp_extract_all({{0}}, '{_CONTROL}')))"

OP8 = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS whole,
           coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
           sum({sum(map(len, MARKS))} + {_WRITTEN.format("role")} + {_WRITTEN.format("text")}) AS formatted
    FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars
FROM c
"""

OP10 = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS words
    FROM documents
), windows AS (
    SELECT r, j, md5(array_to_string(words[j : j + 34], ' ')) AS h
    FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS j FROM d)
), twice AS (
    SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT r, unnest(range(j, j + 35)) AS p FROM windows JOIN twice USING (h)
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
    FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d)
    ANTI JOIN gone USING (r, p)
    GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP11 = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), total AS (
    SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), f AS (
    SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS p, count(*) AS f
    FROM starts, range(1, {collocations.LONGEST + 1}) AS t(m)
    WHERE i + m - 1 <= len(words)
    GROUP BY ALL HAVING count(*) >= {collocations.LEAST}
), c AS (
    SELECT lang, m, p, f AS a, string_split(p, ' ') AS words FROM f WHERE m > 1
), longer AS (
    SELECT lang, p, max(a) AS a FROM (
        SELECT lang, array_to_string(words[1 : m - 1], ' ') AS p, a FROM c
        UNION ALL SELECT lang, array_to_string(words[2 : m], ' '), a FROM c)
    GROUP BY lang, p
), cuts AS (
    SELECT c.lang, c.p, c.a, total.n, x.f AS l, y.f AS r, k,
           (1000::HUGEINT * c.a * total.n) // (x.f::HUGEINT * y.f) AS score
    FROM c JOIN total USING (lang), range(1, {collocations.LONGEST}) AS t(k), f AS x, f AS y
    WHERE k < c.m AND x.lang = c.lang AND y.lang = c.lang
      AND x.p = array_to_string(c.words[1 : k], ' ') AND y.p = array_to_string(c.words[k + 1 : c.m], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
    SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, best.a DESC, p) AS rank
    FROM best LEFT JOIN longer USING (lang, p)
    WHERE longer.a IS NULL OR 100 * longer.a < {collocations.PERCENT} * best.a
)
SELECT lang, rank, p AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {collocations.TOP}
"""

_CID_CRC = """
    list_reduce(
      list_prepend(4294967295, list_transform(range(length(c)), lambda i: ord(c[i + 1])::BIGINT)),
      lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]))
"""

OP12 = f"""
WITH steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own FROM t GROUP BY conv_id
), planned AS (
    SELECT own.conv_id, own, xor({_CID_CRC.replace("(c)", "(conv_id::VARCHAR)").replace("ord(c[", "ord((conv_id::VARCHAR)[")}, 4294967295) % 6 AS h
    FROM own, steps
), seqs AS (
    SELECT p.conv_id, list_concat(coalesce(b.own[1 : h], []), p.own[h + 1 :]) AS s
    FROM planned AS p LEFT JOIN own AS b ON b.conv_id = p.conv_id - p.conv_id % 100
), prefixes AS (
    SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM seqs
), nodes AS (
    SELECT depth, s[1 : depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
    FROM prefixes GROUP BY ALL
), valued AS (
    SELECT x.*, count(y.depth) AS n_children,
           (x.n_convs - 1) * coalesce(length(x.key[x.depth].text), 0) AS own
    FROM nodes AS x LEFT JOIN nodes AS y ON y.depth = x.depth + 1 AND y.key[1 : x.depth] = x.key
    GROUP BY ALL
)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children,
       (SELECT count(*) FROM valued AS y WHERE y.n_children = 0 AND y.key[1 : x.depth] = x.key) AS n_leaves,
       (SELECT sum(y.own) FROM valued AS y WHERE y.key[1 : x.depth] = x.key)::BIGINT AS saved_tokens,
       sha256(x.ends) AS ends_sha256
FROM valued AS x LEFT JOIN nodes AS p ON p.depth = x.depth - 1 AND p.key = x.key[1 : x.depth - 1]
"""

_X = list(VECTOR)
_MEANS = [f"m{i}" for i in range(P)]
_LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
_WHITE = ", ".join([*_MEANS, *(f"w{i}{j}" for i, j in _LOWER)])


def _distance() -> str:
    parts = [" + ".join(f"w{i}{j} * ({_X[j]} - m{j})" for j in range(i + 1)) for i in range(P)]
    return " + ".join(f"({part}) * ({part})" for part in parts)


def _formulas(share: float) -> tuple[str, str, str]:
    """Moments of the nearest share, the factor and its inverse, and the determinant's logarithm."""
    moments = [f"avg({x}) AS m{i}" for i, x in enumerate(_X)]
    least = list(VECTOR.values())
    for i, j in _LOWER:
        floor = f" + {least[i] ** 2!r}" if i == j else ""
        moments.append(f"{consistency(share)!r} * covar_pop({_X[i]}, {_X[j]}){floor} AS c{i}{j}")
    factor = []
    for i, j in _LOWER:
        rest = " - ".join([f"c{i}{j}", *(f"l{i}{n} * l{j}{n}" for n in range(j))])
        factor.append(f"sqrt({rest}) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    for i, j in _LOWER:
        rest = " + ".join(f"l{i}{n} * w{n}{j}" for n in range(j, i))
        factor.append(f"1 / l{i}{i} AS w{i}{i}" if i == j else f"-({rest}) / l{i}{i} AS w{i}{j}")
    return ", ".join(moments), ", ".join(factor), " + ".join(f"2 * ln(l{i}{i})" for i in range(P))


def _estimate(name: str, measured: str, share: float) -> str:
    """The estimates of each start from the nearest share."""
    moments, factor, log_det = _formulas(share)
    return f"""
    {name}_d AS MATERIALIZED ({measured}), {name}_core AS MATERIALIZED (
        SELECT * FROM {name}_d JOIN (
            SELECT grp, start, quantile_disc(d2, {share}) AS radius FROM {name}_d GROUP BY ALL) USING (grp, start)
        WHERE d2 <= radius
    ), {name}_moments AS MATERIALIZED (
        SELECT grp, start, {moments} FROM {name}_core GROUP BY grp, start
    ), {name} AS MATERIALIZED (
        SELECT grp, start, {_WHITE}, {log_det} AS log_det
        FROM (SELECT grp, start, {", ".join(_MEANS)}, {factor} FROM {name}_moments)
    )"""


def _starts() -> str:
    z = [f"abs(({x} - q_{x}) / s_{x})" for x in _X]
    size = {
        "all": "0.0",
        "euclid": " + ".join(f"{a} * {a}" for a in z),
        "largest": f"greatest({', '.join(z)})",
        "sum": " + ".join(z),
    }
    rows = " UNION ALL ".join(
        f"SELECT grp, '{name}' AS start, {', '.join(_X)}, {size[name]} AS d2 FROM v JOIN quartiles USING (grp)" for name in STARTS
    )
    return _estimate("e0", rows, FIRST_CORE)


def _quartile_columns() -> str:
    columns = []
    for x, least in VECTOR.items():
        spread = f"((quantile_disc({x}, 0.75) - quantile_disc({x}, 0.25)) / 1.349)"
        columns += [f"quantile_disc({x}, 0.5) AS q_{x}", f"sqrt({spread} * {spread} + {least**2!r}) AS s_{x}"]
    return ", ".join(columns)


def _nearer(name: str, before: str) -> str:
    return _estimate(name, f"SELECT v.*, start, {_distance()} AS d2 FROM v JOIN {before} USING (grp)", CORE)


def _settled() -> str:
    """The best start's estimates, step by step as long as the determinant falls: the last that fell."""
    moments, factor, log_det = _formulas(CORE)
    return f"""b AS (
    SELECT grp, start, {_WHITE}, log_det, 0 AS k, true AS falls FROM (SELECT * FROM e{FIRST_STEPS}
        QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(log_det, 9), start) = 1)
    UNION ALL
    SELECT grp, start, {_WHITE}, log_det, k + 1, log_det < old_det - {FALL!r} FROM (
        SELECT grp, start, k, old_det, {", ".join(_MEANS)}, {factor}, {log_det} AS log_det FROM (
            SELECT grp, any_value(start) AS start, any_value(k) AS k, any_value(old_det) AS old_det, {moments}
            FROM (SELECT *, quantile_disc(d2, {CORE}) OVER (PARTITION BY grp) AS radius FROM (
                SELECT grp, start, k, log_det AS old_det, {", ".join(_X)}, {_distance()} AS d2
                FROM v JOIN b USING (grp) WHERE falls))
            WHERE d2 <= radius GROUP BY grp))
    WHERE k < {MOST}
), settled AS (
    SELECT * FROM b WHERE falls QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k DESC) = 1
)"""


def _grp(*parts: str) -> str:
    named = [f"coalesce('=' || {p}, '-')" for p in parts]
    return f"concat_ws(chr(10), {', '.join([repr(str(len(parts))), *named])})"


OP7 = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), parts AS (
    SELECT *, list_filter(string_split_regex(t, '{_BLANKS}'), lambda x: x <> '') AS words,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM d
), threes AS (
    SELECT r, i, array_to_string(words[i : i + 2], ' ') AS three
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM parts)
), repeats AS (
    SELECT r, count(DISTINCT p)::BIGINT AS n FROM (
        SELECT r, unnest(range(i, i + 3)) AS p FROM threes
        JOIN (SELECT r, three FROM threes GROUP BY r, three HAVING count(*) > 1) USING (r, three))
    GROUP BY r
), counts AS (
    SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words,
           length(regexp_replace(t, '{_BLANKS}', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
           coalesce(repeats.n, 0) AS n_repeat_words,
           length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM parts LEFT JOIN repeats USING (r)
), sound AS MATERIALIZED (
    SELECT r, lang, source, ln(n_words) AS log_words, ln(word_chars / n_words) AS log_word_length,
           n_symbols / word_chars AS symbol_share, n_dup_lines / n_lines AS dup_line_share,
           n_repeat_words / n_words AS repeat_share, n_upper / word_chars AS upper_share,
           count(*) OVER (PARTITION BY lang, source) AS n, count(*) OVER (PARTITION BY lang) AS n_lang
    FROM counts WHERE NOT base_failed
), asked AS MATERIALIZED (
    SELECT *, CASE WHEN n >= {LEAST} THEN {_grp("lang", "source")} WHEN n_lang >= {LEAST} THEN {_grp("lang")}
              ELSE {_grp()} END AS own
    FROM sound
), v AS MATERIALIZED (
    SELECT * FROM (SELECT *, unnest([{_grp("lang", "source")}, {_grp("lang")}, {_grp()}]) AS grp FROM sound)
    WHERE grp IN (SELECT own FROM asked)
), quartiles AS MATERIALIZED (
    SELECT grp, {_quartile_columns()} FROM v GROUP BY grp HAVING count(*) >= {LEAST}
), {_starts()}, {", ".join(_nearer(f"e{k}", f"e{k - 1}") for k in range(1, FIRST_STEPS + 1))}, {_settled()},
far AS (
    SELECT r, {_distance()} > {CUT!r} AS rejected FROM asked JOIN settled ON own = grp
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM counts LEFT JOIN far USING (r)
"""

ORACLES = {
    "op1_rendezvous_shards": OP1,
    "op3_minhash_odd_sketches": OP3,
    "op7_robust_outliers": OP7,
    "op8_token_level_chat": OP8,
    "op10_debruijn_substrings": OP10,
    "op11_stripe_collocations": OP11,
    "op12_conversation_trie": OP12,
}
