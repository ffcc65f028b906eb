"""SQL text helpers for the DuckDB oracles (same math as the Spark side)."""

from __future__ import annotations


def U(seed, key: str) -> str:
    return (f"((('0x' || substr(md5('{seed}' || ':' || CAST({key} AS VARCHAR)), 1, 13))::BIGINT)::DOUBLE"
            f" / 4503599627370496.0)")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(xs) -> str:
    return ", ".join(lit(x) for x in xs)


WS_CLASS = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def normalize_ws(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS_CLASS}', ' ', 'g'))"


def mask_chain(e: str, patterns: list[str]) -> str:
    for p in patterns:
        e = f"regexp_replace({e}, {lit(p)}, '', 'gi')"
    return e


def re_escape(term: str) -> str:
    meta = set("\\^$.|?*+()[]{}")
    return "".join("\\" + c if c in meta else c for c in term)


def mask_sequential(e: str, terms: list[str]) -> str:
    ordered = sorted(terms, key=len, reverse=True)
    return mask_chain(e, [r"\b" + re_escape(t) + r"\b" for t in ordered])


W = ("(SELECT d.doc_id AS id, d.text, d.lang, CAST(l.toxic AS INTEGER) AS target "
     "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")

E = ("(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(label = 0 AS INTEGER) AS target "
     "FROM embeddings)")


#: Embeddings with a target that they determine: about a quarter of the rows are positive.
L = ("(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, CAST(CAST(embedding[1] AS DOUBLE) + embedding[2] "
     "+ embedding[3] + embedding[4] > 0.15 AS INTEGER) AS target FROM embeddings)")


def allocation(counts: str, test_size: float, target: str = "target") -> str:
    """Per-class test counts k (largest-remainder rule) from a (target, n_c) relation."""
    return f"""(SELECT {target}, n_c, n_c - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS k FROM (
  SELECT *, ntrain - sum(fl) OVER () AS need,
         row_number() OVER (ORDER BY cont - fl DESC, {target}) AS rk FROM (
    SELECT *, floor(cont) AS fl FROM (
      SELECT {target}, n_c, ntrain, n_c::DOUBLE * ntrain / n AS cont FROM (
        SELECT {target}, n_c, n, n - ceil({float(test_size)!r}::DOUBLE * n) AS ntrain FROM (
          SELECT {target}, n_c, sum(n_c) OVER () AS n FROM {counts}))))))"""


def split_flags(rel: str, test_size: float, seed: str, id_col: str = "id", target: str = "target",
                extra: str = "") -> str:
    """rel + is_test flag (rank by (u, id) within class <= k)."""
    return f"""(SELECT r.* EXCLUDE (rn){extra}, rn <= a.k AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {U(seed, id_col)}, {id_col}) AS rn FROM {rel}) r
  JOIN {allocation(f"(SELECT {target}, count(*) AS n_c FROM {rel} GROUP BY {target})", test_size, target)} a
  USING ({target}))"""
