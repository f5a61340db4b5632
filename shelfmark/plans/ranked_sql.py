"""DuckDB SQL of the fuzzy rankings, written from the rules: every row, every word, nothing left out by an index."""

from __future__ import annotations

from collections import Counter

from .oracle import RICH
from .query_text import Clause, RichQuery, compile_clauses, min_support_of, term_weight, weight_target

FIELDS = ("offer", "title", "shop")
_TEXT = {"offer": "o", "title": "t", "shop": "s", "blob": "b"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ratio(q: str, x: str) -> str:
    return f"(least({len(q)}, len({x})) / CAST(greatest({len(q)}, len({x})) AS DOUBLE))"


def _back(x: str) -> str:
    return f"(len({x}) >= 3 OR (len({x}) >= 2 AND regexp_matches({x}, '[0-9]')))"


def dice(q: str, x: str) -> str:
    """Bigram Dice value of a literal and a column, repeats counted; 0 below what the lengths allow for 0.72."""
    grams = Counter(q[i:i + 2] for i in range(len(q) - 1))
    pieces = " + ".join(
        f"least({n}, len([i FOR i IN range(1, len({x})) IF substr({x}, CAST(i AS INTEGER), 2) = {_quoted(g)}]))" for g, n in grams.items())
    reach = f"(least({len(q)}, len({x})) - 1) * 2 >= ({len(q)} + len({x}) - 2) * 0.72"
    return f"CASE WHEN least({len(q)}, len({x})) >= 2 AND {reach} THEN ({pieces or 0}) * 2.0 / ({len(q)} + len({x}) - 2) ELSE 0.0 END"


def _dice_band(q: str, x: str) -> str:
    return f"CASE WHEN {dice(q, x)} >= 0.72 THEN ({dice(q, x)} - 0.72) * 0.9 + 0.58 ELSE 0.0 END"


def similar(q: str, x: str) -> str:
    """Similarity of a literal and a token."""
    lit = _quoted(q)
    long = f"len({x}) >= 3" if len(q) >= 3 else "false"
    return f"""CASE WHEN len({x}) = 0 THEN 0.0 WHEN {x} = {lit} THEN 1.0
      WHEN starts_with({x}, {lit}) OR ({_back(x)} AND starts_with({lit}, {x})) THEN {_ratio(q, x)} * 0.12 + 0.82
      WHEN NOT {long} THEN 0.0
      WHEN contains({x}, {lit}) OR ({_back(x)} AND contains({lit}, {x})) THEN {_ratio(q, x)} * 0.18 + 0.68
      WHEN {x}[1] = {_quoted(q[0])} AND levenshtein({x}, {lit}) <= 2 THEN (2 - levenshtein({x}, {lit})) / 2.0 * 0.16 + 0.72
      ELSE {_dice_band(q, x)} END"""


def packed(q: str, x: str) -> str:
    """Support of a literal by a whole text without spaces."""
    lit = _quoted(q)
    loose = "true" if len(q) >= 3 or any(c.isdigit() for c in q) else "false"
    k = f"least(3, greatest(2, greatest({len(q)}, len({x})) // 4))"
    near = f"abs(len({x}) - {len(q)}) <= {k}"
    return f"""CASE WHEN len({x}) = 0 THEN 0.0 WHEN {x} = {lit} THEN 1.0 WHEN NOT {loose} THEN 0.0
      WHEN starts_with({x}, {lit}) OR ({_back(x)} AND starts_with({lit}, {x})) THEN {_ratio(q, x)} * 0.12 + 0.84
      WHEN contains({x}, {lit}) OR ({_back(x)} AND contains({lit}, {x})) THEN {_ratio(q, x)} * 0.16 + 0.76
      WHEN {near} AND levenshtein({x}, {lit}) <= {k} THEN ({k} - levenshtein({x}, {lit})) / CAST({k} AS DOUBLE) * 0.18 + 0.62
      ELSE {_dice_band(q, x)} END"""


def _parts_of(q: str, x: str) -> str:
    """Similarity of a literal part number and a part token, with the shared beginning."""
    lit, n = _quoted(q), len(q)
    lead = f"coalesce(list_max([i FOR i IN range(0, {n + 1}) IF i <= len({x}) AND {lit}[1:i] = {x}[1:i]]), 0)"
    grams = Counter(q[i:i + 2] for i in range(n - 1))
    overlap = " + ".join(
        f"least({c}, len([i FOR i IN range(1, len({x})) IF substr({x}, CAST(i AS INTEGER), 2) = {_quoted(g)}]))" for g, c in grams.items())
    k = f"least(4, greatest(2, greatest({n}, len({x})) // 4))"
    return f"""SELECT token, lead, CASE WHEN token = {lit} THEN 1.0 WHEN starts_with(token, {lit}) THEN ratio * 0.06 + 0.92
      WHEN len(token) >= 5 AND starts_with({lit}, token) THEN ratio * 0.08 + 0.82 WHEN contains(token, {lit}) THEN ratio * 0.06 + 0.86
      WHEN len(token) >= 5 AND contains({lit}, token) THEN ratio * 0.08 + 0.76 WHEN lead < 3 THEN 0.0
      WHEN lead >= 5 AND edit >= 0.72 THEN greatest(0.68, least(0.91, edit * 0.68 + share * 0.23 + dice * 0.09))
      WHEN lead >= 5 AND dice >= 0.72 THEN greatest(0.62, least(0.84, share * 0.48 + dice * 0.34))
      WHEN lead >= 5 THEN greatest(0.54, least(0.82, share * 0.62 + ratio * 0.12 + dice * 0.08))
      WHEN lead >= 4 AND shorter <= 6 THEN greatest(0.6, least(0.82, share * 0.7 + ratio * 0.1))
      WHEN dice >= 0.82 AND lead >= 3 THEN least(0.78, dice * 0.72 + share * 0.08) ELSE 0.0 END AS support
    FROM (SELECT token, lead, shorter, {_ratio(q, 'token')} AS ratio, lead / CAST(shorter AS DOUBLE) AS share,
        CASE WHEN abs(len(token) - {n}) <= {k} AND levenshtein(token, {lit}) <= {k} THEN 1.0 - levenshtein(token, {lit}) / CAST(greatest({n}, len(token)) AS DOUBLE)
          ELSE 0.0 END AS edit, ({overlap}) * 2.0 / ({n} + len(token) - 2) AS dice
      FROM (SELECT token, {lead.replace(x, 'token')} AS lead, least({n}, len(token)) AS shorter FROM (SELECT DISTINCT token FROM parts) d0) d1) d2"""


class _Sql:
    """Collects the tables of one query."""

    def __init__(self, query: RichQuery):
        self.query = query
        self.tables = [RICH.strip(), """base AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, replace(t, ' ', '') AS tp, replace(o, ' ', '') AS op,
  replace(s, ' ', '') AS sp, replace(b, ' ', '') AS bp, list_filter(string_split(t, ' '), lambda w: w <> '') AS ts,
  list_filter(string_split(o, ' '), lambda w: w <> '') AS os, list_filter(string_split(s, ' '), lambda w: w <> '') AS ss,
  list_filter(string_split(b, ' '), lambda w: w <> '') AS bs FROM rx)""",
                       "ft AS MATERIALIZED (SELECT DISTINCT rid, field, unnest(words) AS token FROM (SELECT rid, unnest(['offer', 'title', 'shop']) AS field, "
                       "unnest([os, ts, ss]) AS words FROM base) x)"]
        self.joins: list[str] = []
        self.columns: list[str] = []

    def words(self, words: list[str]) -> dict[str, dict[str, str]]:
        """Support of each word by field, as columns of the joined table."""
        out = {}
        for n, w in enumerate(words):
            self.tables.append(f"d{n} AS MATERIALIZED (SELECT token, {similar(w, 'token')} AS support FROM (SELECT DISTINCT token FROM ft) x)")
            best = ", ".join(f"max(CASE WHEN field = '{f}' THEN support END) AS {f}" for f in FIELDS)
            self.tables.append(f"w{n} AS MATERIALIZED (SELECT rid, {best} FROM ft JOIN d{n} USING (token) WHERE support > 0 GROUP BY rid)")
            self.joins.append(f"LEFT JOIN w{n} ON w{n}.rid = base.rid")
            cells = {f: f"greatest(coalesce(w{n}.{f}, 0.0), {packed(w, 'base.' + _TEXT[f] + 'p')})" for f in FIELDS}
            cells["blob"] = f"greatest(CASE WHEN list_contains(base.bs, {_quoted(w)}) THEN 0.84 ELSE 0.0 END, {packed(w, 'base.bp')})"
            self.columns += [f"{x} AS e{n}_{f}" for f, x in cells.items()]
            out[w] = {f: f"e{n}_{f}" for f in cells} | {"best": f"greatest({', '.join(f'e{n}_{f}' for f in cells)})"}
        return out

    def run(self, j: int, clause: Clause) -> dict[str, str]:
        """Support of a clause run together, by title and blob."""
        q, width = clause.compact, max(1, len(clause.smart_words))
        for f, seq in (("title", "ts"), ("blob", "bs")):
            direct = packed(q, f"base.{_TEXT[f]}p")
            if width > 1:
                self.tables.append(f"""x{j}{f} AS MATERIALIZED (SELECT DISTINCT rid, unnest(flatten([[array_to_string({seq}[i:i + k - 1], '')
  FOR i IN range(1, len({seq}) - k + 2)] FOR k IN range(1, {width + 2})])) AS win FROM base)""")
                self.tables.append(f"y{j}{f} AS MATERIALIZED (SELECT win, greatest({packed(q, 'win')}, {similar(q, 'win')}) AS support "
                                   f"FROM (SELECT DISTINCT win FROM x{j}{f}) u)")
                self.tables.append(f"z{j}{f} AS MATERIALIZED (SELECT rid, max(support) AS support FROM x{j}{f} JOIN y{j}{f} USING (win) GROUP BY rid)")
                self.joins.append(f"LEFT JOIN z{j}{f} ON z{j}{f}.rid = base.rid")
                direct = f"CASE WHEN {direct} >= 0.999 THEN {direct} ELSE greatest({direct}, coalesce(z{j}{f}.support, 0.0)) END"
            self.columns.append(f"{direct} AS r{j}_{f}")
        return {"title": f"r{j}_title", "blob": f"r{j}_blob", "best": f"greatest(r{j}_title, r{j}_blob)"}

    def build(self, results: list[dict[str, str]], where: str = "true", default: bool = False) -> str:
        """The best result of the clauses; the earlier one wins a tie."""
        tables = [*self.tables, f"ev AS MATERIALIZED (SELECT base.*{''.join(', ' + c for c in self.columns)} FROM base {' '.join(self.joins)})"]
        names = ("score", "exact_terms", "matched_terms", "title_terms", "smart_guess")
        cells = []
        for j, r in enumerate(results):
            cells += [f"CASE WHEN {r['keep']} THEN {r[n]} END AS {n}{j}" for n in names]
        tables.append(f"rated AS MATERIALIZED (SELECT *, {', '.join(cells)} FROM ev WHERE {where})")
        best = "CASE " + " ".join(
            f"WHEN score{j} IS NOT NULL AND " + " AND ".join([f"coalesce(score{j} > score{i}, true)" for i in range(j)]
                                                             + [f"coalesce(score{j} >= score{i}, true)" for i in range(j + 1, len(results))] or ["true"])
            + f" THEN {j}" for j in range(len(results))) + " END"
        zero = {"score": "0.0", "smart_guess": "false"}
        shown = []
        for n in names:
            picked = "CASE pick " + " ".join(f"WHEN {j} THEN {n}{j}" for j in range(len(results))) + (
                f" ELSE {zero.get(n, '0')}" if default else "") + " END"
            shown.append(f"round(CAST({picked} AS DOUBLE), 4) AS score" if n == "score" else f"{picked} AS {n}" if n == "smart_guess"
                         else f"CAST({picked} AS INTEGER) AS {n}")
        keep = "" if default else " WHERE pick IS NOT NULL"
        return f"WITH {', '.join(tables)} SELECT offer_id, shop, {', '.join(shown)} FROM (SELECT *, {best} AS pick FROM rated) f{keep}"


def _flag(condition: str, points: float = 1) -> str:
    return f"CASE WHEN {condition} THEN {points} ELSE 0 END"


def _sum(items: list[str]) -> str:
    return "(" + (" + ".join(f"({x})" for x in items) or "0") + ")"


def _hits(seq: str, words: list[str]) -> str:
    """How many words come up one after the other: for each, where it first stands behind the one before."""
    out, at = "0", "0"
    for n, w in enumerate(words, 1):
        spot = f"list_position({seq}[({at}) + 1:], {_quoted(w)})"
        out = f"CASE WHEN {out} = {n - 1} AND {spot} > 0 THEN {n} ELSE {out} END"
        at = f"({at}) + coalesce({spot}, 0)"
    return out


def text_relevance_sql(text: str) -> str:
    query = compile_clauses(text)
    sql = _Sql(query)
    ev = sql.words(list(dict.fromkeys(w for c in query.clauses for w in (*c.words, *c.not_words))))
    results = []
    for clause in query.clauses:
        score, matched, exact, title = [], [], [], []
        for phrase in clause.phrases:
            p = phrase.replace(" ", "")
            found = (f"(contains(t, {_quoted(phrase)}) OR contains(b, {_quoted(phrase)}) OR {packed(p, 'tp')} >= 0.84 OR {packed(p, 'bp')} >= 0.84)")
            titled = f"({found} AND (contains(t, {_quoted(phrase)}) OR contains(tp, {_quoted(p)})))"
            same = f"({found} AND (tp = {_quoted(p)} OR op = {_quoted(p)}))"
            score += [f"CASE WHEN {titled} THEN 460 WHEN {found} THEN 220 ELSE 0 END", _flag(same, 360)]
            matched.append(_flag(found))
            exact.append(_flag(same))
            title.append(_flag(titled))
        for w in clause.words:
            e, floor = ev[w], min_support_of(w)
            found = f"({e['best']} >= {floor})"
            same = f"({found} AND (list_contains(os, {_quoted(w)}) OR list_contains(ts, {_quoted(w)})))"
            gain = f"greatest({e['offer']} * 460, {e['title']} * 420, {e['blob']} * 180, {e['shop']} * 90) + {_flag(same, 140)}"
            score.append(f"CASE WHEN {found} THEN {gain} ELSE 0 END")
            matched.append(_flag(found))
            exact.append(_flag(same))
            title.append(_flag(f"{found} AND {e['title']} >= {floor}"))
        m, x, t = _sum(matched), _sum(exact), _sum(title)
        bonus = f"{m} * 160 + {t} * 120 + {x} * 90 + {_flag(f'{m} >= {-(-clause.size * 6 // 10)}', 360)}"
        results.append({"keep": f"{m} > 0", "score": f"{_sum(score)} + {bonus}", "exact_terms": x, "matched_terms": m, "title_terms": t,
                        "smart_guess": "false"})
    return sql.build(results, default=True)


def related_parts_sql(text: str, least: float) -> str:
    query = compile_clauses(text)
    sql = _Sql(query)
    (clause,) = query.clauses
    q = clause.compact
    lit = _quoted(q)
    sql.tables.append(f"pd AS MATERIALIZED ({_parts_of(q, 'token')})")
    sql.tables.append("""pt AS MATERIALIZED (SELECT rid, token, min(place) AS place FROM (SELECT rid, unnest(ws) AS token, generate_subscripts(ws, 1) AS place
  FROM (SELECT rid, os || ts || bs AS ws FROM base) a) c WHERE token IN (SELECT token FROM parts) GROUP BY 1, 2)""")
    sql.tables.append("""pb AS MATERIALIZED (SELECT * FROM (SELECT rid, token, support, row_number() OVER (PARTITION BY rid ORDER BY support DESC, place) AS n
  FROM pt JOIN pd USING (token) WHERE support > 0) d WHERE n = 1)""")
    sql.joins.append("LEFT JOIN pb ON pb.rid = base.rid")
    own, title, blob = "coalesce(pb.support, 0.0)", packed(q, "base.tp"), packed(q, "base.bp")
    best = f"greatest({own}, {title})"
    by_blob, by_title = f"{blob} > {best}", f"{title} > {own}"
    hit = "coalesce(list_contains(base.ts, pb.token) OR contains(base.tp, pb.token), false)"
    sql.columns += [
        f"greatest({best}, {blob}) AS support",
        f"CASE WHEN {by_blob} THEN base.bp = {lit} WHEN {by_title} THEN base.tp = {lit} ELSE coalesce(pb.token = {lit}, false) END AS exact",
        f"CASE WHEN {by_title} THEN true ELSE {hit} END AS title_hit",
        f"CASE WHEN {by_blob} OR {by_title} THEN {lit} ELSE coalesce(pb.token, '') END AS candidate"]
    lead = f"coalesce(list_max([i FOR i IN range(0, {len(q) + 1}) IF i <= len(candidate) AND {lit}[1:i] = candidate[1:i]]), 0)"
    letters = "".join(c for c in q[:next((i for i, c in enumerate(q) if not c.isalpha()), len(q))])
    family = f"(regexp_extract(candidate, '^[a-z]+') = {_quoted(letters)} AND {_quoted(letters)} <> '')"
    contained = f"(contains(tp, {lit}) OR contains(op, {lit}))"
    component = r"regexp_matches(concat_ws(' ', t, b), '\b(mosfet|field effect|fet|transistor|tube|chip|ic|power)\b')"
    score = _sum(["support * 3600", _flag("exact", 2600), _flag(contained, 1400), _flag("title_hit", 760), _flag(family, 420), f"{lead} * 680",
                  _flag(component, 260)])
    return sql.build([{"keep": f"support >= {least}", "score": score, "exact_terms": _flag(f"exact OR {contained}"), "matched_terms": "1",
                       "title_terms": _flag("title_hit"), "smart_guess": "NOT exact"}])


def smart_sql(text: str) -> str:
    """For clauses of two or three plain words."""
    query = compile_clauses(text)
    sql = _Sql(query)
    ev = sql.words(list(dict.fromkeys(w for c in query.clauses for w in c.words)))
    results = []
    for j, clause in enumerate(query.clauses):
        run, words, n = sql.run(j, clause), clause.smart_words, len(clause.words)
        best = {w: ev[w]["best"] for w in clause.words}
        floor = {w: min_support_of(w) for w in clause.words}
        points = [f"greatest({e['offer']} * 480, {e['title']} * 320, {e['blob']} * 170, {e['shop']} * 110) + {e['best']} * 45"
                  for e in (ev[w] for w in clause.words)]
        ordered = _hits("ts", words)
        points.append(f"CASE WHEN {ordered} = {n} THEN 190 ELSE ({ordered}) * 30 END")
        points.append(_flag(f"{_hits('bs', words)} = {n}", 80))
        points.append(_flag(f"len(ts) > 0 AND greatest({similar(words[0], 'ts[1]')}, {packed(words[0], 'ts[1]')}) >= 0.88", 85))
        failed = _sum([_flag(f"{best[w]} < {floor[w]}") for w in best])
        hopeless = _sum([_flag(f"{best[w]} < {max(0.42, floor[w] - 0.18)}") for w in best])
        strong = f"{_sum([_flag(f'{best[w]} >= 0.84') for w in best])} >= {max(1, n - 1)}"
        together = f"({run['best']} >= 0.66 AND {strong})"
        rescued = (f"({hopeless} <= 1 AND {strong} AND ({together} OR ({n} - {failed}) / {n}.0 >= {0.75 if n >= 4 else 0.67}) AND "
                   f"({together} OR {run['best']} >= 0.84 OR {_sum(list(best.values()))} / {n} >= 0.73))")
        weak = f"{failed} > 0"
        title = _sum([_flag(f"{ev[w]['title']} >= {floor[w]}") for w in best])
        exact = _sum([_flag(f"{best[w]} = 1") for w in best])
        score = _sum([*points, f"CASE WHEN {run['title']} >= 0.78 THEN {run['title']} * CASE WHEN {weak} THEN 150 ELSE 230 END ELSE 0 END",
                      f"CASE WHEN {run['blob']} >= 0.78 THEN {run['blob']} * CASE WHEN {weak} THEN 70 ELSE 120 END ELSE 0 END"])
        matched = f"({n} - {failed})"
        whole = f"{_flag(f'{title} = {n}', 140)} + CASE WHEN {exact} = {n} THEN 220 WHEN {matched} = {n} THEN 140 ELSE 0 END"
        results.append({"keep": f"({failed} = 0 OR {rescued})", "score": f"CASE WHEN {weak} THEN {score} * 0.76 + {run['best']} * 120 ELSE {score} + {whole} END",
                        "exact_terms": exact, "matched_terms": matched, "title_terms": title, "smart_guess": weak})
    return sql.build(results)


def title_index_sql(text: str) -> str:
    """For one clause of plain words of full weight without synonyms."""
    query = compile_clauses(text)
    sql = _Sql(query)
    terms, (clause,) = query.terms, query.clauses
    ev = sql.words(terms)
    run, n, words = sql.run(0, clause), len(terms), clause.smart_words
    # Candidates: rows with a term as a token; for terms that no row has, rows with a token that can stand in for it.
    listed = ", ".join(map(_quoted, terms))
    near = " UNION ALL ".join(
        f"SELECT {_quoted(t)} AS term, token FROM (SELECT token, {similar(t, 'token')} AS a, {packed(t, 'token')} AS b FROM (SELECT DISTINCT token FROM ft "
        f"WHERE field <> 'shop') x) y WHERE token <> {_quoted(t)} AND (a >= {f} OR b >= {f})"
        for t, f in ((t, 0.82 if len(t) <= 4 else 0.72 if len(t) <= 6 else 0.62) for t in terms))
    sql.tables.append(f"there AS MATERIALIZED (SELECT rid, token FROM ft WHERE field <> 'shop' AND token IN ({listed}))")
    sql.tables.append(f"""cand AS MATERIALIZED (SELECT DISTINCT rid FROM there UNION SELECT ft.rid FROM ft JOIN ({near}) k ON ft.token = k.token
  WHERE ft.field <> 'shop' AND k.term NOT IN (SELECT token FROM there))""")
    score, matched, exact, title, weight = [], [], [], [], []
    for t in terms:
        e, w, floor = ev[t], term_weight(t), min_support_of(t)
        ok = f"({e['best']} >= {floor} OR {e['title']} >= 0.58)"
        same = f"(list_contains(ts, {_quoted(t)}) OR list_contains(os, {_quoted(t)}))"
        lift = max(w, 0.4)
        score.append(f"CASE WHEN {ok} THEN {e['best']} * 380 * {lift} + {e['title']} * 520 * {lift} + {_flag(same, 260 * lift)} ELSE 0 END")
        matched.append(_flag(ok))
        weight.append(_flag(ok, w))
        exact.append(_flag(f"{ok} AND {same}"))
        title.append(_flag(f"{ok} AND {e['title']} >= {floor}"))
    by_title, by_blob = _hits("ts", words), _hits("bs", words)
    score += [f"({by_title}) * 130", f"({by_blob}) * 40", _flag(f"greatest({by_title}, {by_blob}) / {len(words)}.0 >= 0.8", 520),
              f"CASE WHEN {run['title']} >= 0.76 THEN {run['title']} * 360 ELSE 0 END"]
    title.append(_flag(f"{run['title']} >= 0.76"))
    s, m, x, t = _sum(score), _sum(matched), _sum(exact), _sum(title)
    thin = f"{m} < 2" if n >= 3 else "false"
    final = (f"(CASE WHEN {_sum(weight)} < {weight_target(terms)} THEN 0.0 WHEN {thin} THEN {s} * 0.2 WHEN {m} / {n}.0 >= 0.8 THEN {s} + 900 "
             f"WHEN {m} / {n}.0 >= 0.55 THEN {s} + 420 ELSE {s} END + {_flag(f'{t} >= {min(n, 3)}', 600)})")
    return sql.build([{"keep": f"({final} > 0 AND {m} > 0)", "score": final, "exact_terms": x, "matched_terms": m, "title_terms": t,
                       "smart_guess": f"{x} < {n}"}], where="rid IN (SELECT rid FROM cand)")


ORACLE = {
    "smart_search": smart_sql("smal widgit OR blue bolt"),
    "title_index_search": title_index_sql("large plate brass"),
    "related_part_search": related_parts_sql("PN120X7", 0.52),
    "text_relevance": text_relevance_sql('"old bolt" economy'),
}
