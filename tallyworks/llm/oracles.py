"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from tallyworks.llm import chat, licenses

_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat() -> str:
    escaped = "{}"
    for control, inside in chat.CONTROL.items():
        escaped = f"replace({escaped}, {_sql(control)}, {_sql(inside)})"
    role, body = escaped.format("role"), escaped.format("text")
    around = len(chat.START) + len(chat.END) + 2
    return f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
    SELECT *, length(replace({role}, chr(10), '\\' || chr(10))) + length({body}) + {around} AS chars FROM t
), g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g
"""


def _licenses() -> str:
    names = ", ".join(f"{_sql(sentence)}: {_sql(name)}" for name, sentence in licenses.SENTENCES.items())
    rest, steps, found = "r0", [], []
    for i, (name, ids) in enumerate(licenses.RULES):
        sequence = _sql("".join(f" {x} " for x in ids))
        found.append(f"CASE WHEN contains({rest}, {sequence}) THEN {_sql(name)} END")
        steps.append(f"replace({rest}, {sequence}, ' ') AS r{i + 1}")
        rest = f"r{i + 1}"
    end = licenses.SENTENCE_END
    return f"""
WITH s AS (
    SELECT doc_id, list_filter(
        list_transform(regexp_split_to_array(coalesce(text, ''), {_sql(end)}),
            lambda x: trim(regexp_replace(lower(x), {_sql(licenses.OTHER)}, ' ', 'g'))),
        lambda x: x <> '') AS sentences
    FROM documents
), n AS (
    SELECT doc_id, len(sentences) AS n_sentences,
        list_transform(sentences, lambda x: coalesce(MAP {{{names}}}[x], '-')) AS names
    FROM s
), q AS (
    SELECT doc_id, n_sentences, len(list_filter(names, lambda x: x <> '-')) AS n_known,
        trim(regexp_replace(' ' || array_to_string(names, ' ') || ' ', '( -)+ ', ' - ', 'g')) AS sequence
    FROM n
), p AS (SELECT *, ' ' || replace(sequence, ' ', '  ') || ' ' AS r0 FROM q),
m AS (SELECT *, {", ".join(steps)} FROM p)
SELECT doc_id, n_sentences, n_known, sequence,
    array_to_string(list_filter([{", ".join(found)}], lambda x, i: x IS NOT NULL
        AND list_position([{", ".join(found)}], x) = i), ',') AS licenses
FROM m
"""


ORACLES: dict[str, str] = {"op1_topk": _TOPK, "op3_licenses": _licenses(), "op4_chat": _chat()}
