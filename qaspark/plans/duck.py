"""DuckDB SQL building blocks for the oracle queries.

The oracle is an independent formulation of each query in plain SQL over the
driver's pre-registered tables; the fixture views of
:mod:`qaspark.sources.fixtures` are restated here as CTEs. Only the fixed
pattern values are shared with the Spark side.
"""

from __future__ import annotations

from qaspark.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(repl)}, 'g')"


def strip(expr: str) -> str:
    return rx(expr, r"^\s+|\s+$", "")


def no_symbol(expr: str) -> str:
    s = rx(expr, T.SYM_APOSTROPHE, r" \1")
    s = rx(s, T.SYM_SPACE, " ")
    s = rx(s, T.SYM_AT, " at ")
    s = rx(s, r" +", " ")
    s = rx(s, T.SYM_LEADING, "")
    s = rx(s, T.SYM_TRAILING, "")
    return strip(s)


def tokenize(expr: str) -> str:
    s = f"lower({expr})"
    for i, (name, abbr) in enumerate(T.MONTHS):
        s = rx(s, rf"\b{name}\b|\b{abbr}\b", "%02d" % (i + 1))
    for pattern, token in T.TYPED_REWRITES:
        s = rx(s, pattern, token)
    return f"CASE WHEN upper({expr}) = {expr} THEN {expr} ELSE {strip(s)} END"


def split_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda x: x <> '')"


def capitalize(expr: str) -> str:
    return f"(upper(substring({expr}, 1, 1)) || lower(substring({expr}, 2)))"


def clean_question(expr: str) -> str:
    return capitalize(f"replace({no_symbol(expr)}, {lit(T.QUOTE_PAIR)}, ' ')")


def key(*parts) -> str:
    """The line key of the fixtures: parts padded to 20 digits."""
    return " || '-' || ".join(f"lpad(CAST({p} AS VARCHAR), 20, '0')" for p in parts)


# name -> (dependencies, body)
FX: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_triples": ((), """
        SELECT o.o_orderkey AS tid,
               lower(o.o_orderpriority) || CASE WHEN o.o_orderkey % 5 = 0 THEN '-in.r'
                                                WHEN o.o_orderkey % 5 = 1 THEN '-on.r'
                                                ELSE '''s.r' END AS rel,
               c.c_name || '.e' AS e1, n.n_name || '.e' AS e2
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                      JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    "fx_pairs": ((), """
        SELECT u.conv_id, u.turn, u.text AS q, a.text AS a
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "fx_paraphrases": ((), """
        SELECT u.conv_id, u.turn, u.text AS q1, v.text AS q2
        FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 2
        WHERE u.role = 'user' AND v.role = 'user'"""),
    "fx_questions": ((), f"""
        SELECT {key(0, 'conv_id', 'turn')} AS line_no, text AS question, text AS tokens, 'X' AS pos, lower(text) AS lemma
        FROM conversations WHERE role = 'user'
        UNION ALL
        SELECT {key(1, 'conv_id', 'turn')}, text, 'again ' || text, 'X', lower(text)
        FROM conversations WHERE role = 'user' AND conv_id % 5 = 0"""),
    "fx_alignments": ((), f"""
        SELECT {key('a.conv_id', 'a.turn', 'b.turn')} AS line_no, lower(a.text) AS lemma1,
               lower(b.text) || CASE WHEN (b.conv_id + b.turn) % 7 = 0 THEN ' unseen' ELSE '' END AS lemma2
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn IN (a.turn + 2, a.turn + 4, a.turn + 6)
        WHERE a.role = 'user' AND b.role = 'user'"""),
    "fx_tokens": ((), f"""
        SELECT doc_id, token FROM (SELECT doc_id, unnest({split_ws('lower(text)')}) AS token FROM documents)"""),
    "fx_vocab": (("fx_tokens",), """
        SELECT token, row_number() OVER (ORDER BY token) AS idx
        FROM (SELECT token FROM fx_tokens GROUP BY token HAVING count(*) > 3)"""),
    "fx_emb": ((), "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"),
    "fx_word_vectors": (("fx_vocab", "fx_emb"), """
        SELECT v.token, e.vec FROM fx_vocab v
        JOIN fx_emb e ON e.vec_id = v.idx % (SELECT count(*) FROM embeddings)"""),
    "fx_clustered": (("fx_vocab", "fx_emb"), """
        SELECT token, idx, list_concat(vec[k + 1:], vec[:k]) AS vec, label FROM (
          SELECT v.token, v.idx, e.vec, e.label, ((v.idx - 1) // n.n) % len(e.vec) AS k
          FROM fx_vocab v, (SELECT count(*) AS n FROM embeddings) n, fx_emb e WHERE e.vec_id = (v.idx - 1) % n.n)"""),
    "fx_model_main": (("fx_clustered",), "SELECT token, vec FROM fx_clustered WHERE idx % 3 = 1"),
    "fx_model_other": (("fx_clustered",), "SELECT token, vec FROM fx_clustered WHERE idx % 2 = 0"),
    "fx_labels": ((), """
        SELECT d.source || '-' || CAST(d.doc_id % 7 AS VARCHAR) AS q, CAST(d.doc_id AS VARCHAR) AS answer,
               CAST(l.quality AS INTEGER) AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "fx_preds": ((), f"""
        SELECT {key(0, 'doc_id')} AS line_no, source || '-' || CAST(doc_id % 7 AS VARCHAR) AS q,
               CAST(doc_id AS VARCHAR) AS answer, CAST(n_chars % 7 AS DOUBLE) / 7.0 AS dist FROM documents
        UNION ALL
        SELECT {key(1, 'doc_id')}, source || '-' || CAST(doc_id % 7 AS VARCHAR),
               CAST(doc_id AS VARCHAR), CAST(n_chars % 5 AS DOUBLE) / 5.0 FROM documents WHERE doc_id % 5 = 0"""),
    "fx_eval_questions": (("fx_preds",), """
        SELECT row_number() OVER (ORDER BY q) AS pos, q FROM (
          SELECT DISTINCT q FROM fx_preds
          UNION ALL SELECT 'src_none'
          UNION ALL SELECT min(q) FROM fx_preds)"""),
    "fx_covered": ((), f"""
        SELECT token FROM (
          SELECT token, row_number() OVER (ORDER BY token) AS i FROM (
            SELECT DISTINCT unnest({split_ws('lower(text)')}) AS token FROM conversations))
        WHERE i % 120 <> 0"""),
}


def with_fx(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named fixture CTEs (dependencies first), extra CTEs, then body."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in FX[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({FX[n][1]})" for n in order]
    ctes += [f"{n} AS {sql}" if sql.startswith("MATERIALIZED") else f"{n} AS ({sql})"
             for n, sql in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
