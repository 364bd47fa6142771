"""DuckDB SQL of the registered queries, over the driver's tables."""

from __future__ import annotations

from ..functions.text import diacritics, glob_regex
from . import formats
from .queries import MARKS, MISSPELT, PAIR, RANKED, WILD

WORD = r"[\p{L}0-9]+"
MARKED, PLAIN = diacritics()
PRIME = 2**31 - 1


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tok(text: str = "lower(text)", pattern: str = WORD) -> str:
    return f"""arr AS (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS l FROM documents),
tok AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS off FROM arr)"""


TOK = _tok()


def _counts(text: str = "lower(text)", pattern: str = WORD) -> str:
    return f"WITH {_tok(text, pattern)} SELECT term, count(*) AS n, CAST(sum(off) AS BIGINT) AS offsets FROM tok GROUP BY term"


def _matches(slot: str) -> str:
    return f"regexp_matches(term, '{glob_regex(slot)}')" if "*" in slot else f"term = '{slot}'"


def _and(slots: list[str]) -> str:
    return f"WITH {TOK} " + " INTERSECT ".join(f"SELECT DISTINCT doc_id FROM tok WHERE {_matches(s)}" for s in slots)


def _phrase(slots: list[str]) -> str:
    joins = " ".join(f"JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.off = t0.off + {i} AND {_matches(s).replace('term', f't{i}.term')}" for i, s in enumerate(slots) if i)
    return f"WITH {TOK} SELECT DISTINCT t0.doc_id FROM tok t0 {joins} WHERE {_matches(slots[0]).replace('term', 't0.term')}"


def _scored(slots: list[str], integer: bool = True) -> str:
    """CTEs that end in sc(doc_id, score)."""
    weight = " + ".join(f"CASE WHEN {_matches(s)} THEN 1.0 ELSE 0.0 END" for s in slots)
    quotient = "floor(n.n / df.df)" if integer else "n.n / df.df"
    return f"""{TOK},
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE {' OR '.join(_matches(s) for s in slots)} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
sc AS (SELECT tf.doc_id, sum(log10({quotient}) * (CAST({weight.replace('term', 'tf.term')} AS DOUBLE)) * tf.tf / len(arr.l)) AS score
  FROM tf JOIN df ON tf.term = df.term JOIN arr ON arr.doc_id = tf.doc_id CROSS JOIN n GROUP BY tf.doc_id)"""


def _page(first: int, last: int) -> str:
    return f"pg AS (SELECT doc_id, score, rank FROM (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc) WHERE rank BETWEEN {first} AND {last})"


LINKS = """nd AS (SELECT count(*) AS n FROM documents),
edge AS (SELECT DISTINCT src, dst FROM (
  SELECT doc_id AS src, unnest([(doc_id * 7 + 3) % n, (doc_id * doc_id + 1) % n]) AS dst FROM documents CROSS JOIN nd WHERE doc_id % 5 <> 0)),
od AS (SELECT src, count(*) AS outdeg FROM edge GROUP BY src)"""


def _pagerank(steps: int) -> str:
    """CTEs that end in pr(id, score)."""
    out = [LINKS, "node AS (SELECT doc_id AS id, outdeg FROM documents LEFT JOIN od ON doc_id = src)", "r0 AS (SELECT id, outdeg, CASE WHEN id = (SELECT min(id) FROM node) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM node)"]
    for i in range(1, steps + 1):
        out.append(
            f"""r{i} AS MATERIALIZED (SELECT r.id, r.outdeg, 0.85::DOUBLE * coalesce(g.got, 0) + m.m / nd.n AS score FROM r{i - 1} r
LEFT JOIN (SELECT dst, sum(score / outdeg) AS got FROM edge JOIN r{i - 1} ON src = id GROUP BY dst) g ON g.dst = r.id
CROSS JOIN (SELECT sum(CASE WHEN outdeg IS NULL THEN score ELSE 0.15::DOUBLE * score END) AS m FROM r{i - 1}) m CROSS JOIN nd)"""
        )
    out.append(f"pr AS (SELECT id, score FROM r{steps})")
    return ",\n".join(out)


def _hits(edges: str, steps: int) -> str:
    """CTEs over e(src, dst) that end in ht(id, hub, authority). ``edges``: CTEs that define e and ids(id)."""
    out = [edges, "h0 AS (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM ids)"]
    for i in range(1, steps + 1):
        out.append(
            f"""w{i} AS MATERIALIZED (SELECT h.id, coalesce(a.v, 0) AS hub, coalesce(b.v, 0) AS authority FROM h{i - 1} h
LEFT JOIN (SELECT src, sum(authority) AS v FROM e JOIN h{i - 1} ON dst = id GROUP BY src) a ON a.src = h.id
LEFT JOIN (SELECT dst, sum(hub) AS v FROM e JOIN h{i - 1} ON src = id GROUP BY dst) b ON b.dst = h.id)"""
        )
        out.append(
            f"""h{i} AS MATERIALIZED (SELECT id, hub / coalesce(nullif(n.h, 0), 1) AS hub, authority / coalesce(nullif(n.a, 0), 1) AS authority
FROM w{i} CROSS JOIN (SELECT sqrt(sum(hub * hub)) AS h, sqrt(sum(authority * authority)) AS a FROM w{i}) n)"""
        )
    out.append(f"ht AS (SELECT * FROM h{steps})")
    return ",\n".join(out)


ORDERS = """e AS (SELECT DISTINCT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""

ROOT = f"""{TOK},
{LINKS},
root AS (SELECT DISTINCT doc_id AS id FROM tok WHERE term = 'keit')"""
BASE = "ids AS (SELECT id FROM {r} UNION SELECT dst FROM edge JOIN {r} ON src = id UNION SELECT src FROM edge JOIN {r} ON dst = id)"


def _kgram(padded: str = "'^' || term || '$'") -> str:
    return f"""{TOK},
voc AS (SELECT DISTINCT term FROM tok),
kg AS (SELECT DISTINCT term, substr({padded}, CAST(i AS INTEGER), 2) AS gram FROM voc, unnest(range(1, length({padded}))) AS u(i))"""


def _indel(a: str, b: str) -> str:
    """Insertions and deletions at 1, substitutions at 2, as a fold over letters."""
    return (
        f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), "
        f"lambda old, xi: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), "
        f"lambda new, yj: list_append(new, least(new[-1] + 1, old[yj[1] + 1] + 1, old[yj[1]] + CASE WHEN substr({a}, CAST(xi[1] AS INTEGER), 1) = substr({b}, CAST(yj[1] AS INTEGER), 1) THEN 0 ELSE 2 END)), "
        f"[old[1] + 1]), range(0, length({b}) + 1))[-1]"
    )


def _candidates(word: str) -> str:
    """CTEs that end in cd(term, n_word, n_term, overlap): sets of bigrams of terms as they stand, without padding."""
    return f"""{TOK},
own AS (SELECT DISTINCT substr('{word}', CAST(i AS INTEGER), 2) AS gram FROM unnest(range(1, length('{word}'))) AS u(i)),
kg AS (SELECT DISTINCT term, substr(term, CAST(i AS INTEGER), 2) AS gram FROM (SELECT DISTINCT term FROM tok), unnest(range(1, length(term))) AS u(i)),
cd AS (SELECT term, (SELECT count(*) FROM own) AS n_word, count(*) AS n_term, count(own.gram) AS overlap FROM kg LEFT JOIN own ON own.gram = kg.gram GROUP BY term HAVING count(own.gram) > 0)"""


def _suggest(word: str, score: str, most: int) -> str:
    """CTEs that end in sg(term, cf)."""
    return f"""{_candidates(word)},
lk AS (SELECT term FROM cd WHERE {score} >= 0.3 AND abs(length(term) - {len(word)}) <= {most}),
sg AS (SELECT lk.term, f.cf FROM lk JOIN (SELECT term, count(*) AS cf FROM tok GROUP BY term) f ON f.term = lk.term WHERE {_indel(f"'{word}'", 'lk.term')} <= {most})"""


JACCARD = "CAST(overlap AS DOUBLE) / (n_word + n_term - overlap)"


def _sizes(word: str) -> str:
    """The first formula: bigrams counted with repeats, a word of n letters having n - 1."""
    return f"CAST(length(term) - 1 AS DOUBLE) / ({len(word) - 1} + 2 * (length(term) - 1))"


def _feedback(strict: bool) -> str:
    """CTEs that end in fw(term, weight)."""
    relevant = [i + 1 for i, m in enumerate(MARKS[:10]) if m]
    asked = ", ".join(f"('{w}', 1.0::DOUBLE)" for w in RANKED)
    new = f"""{_scored(RANKED)},
{_page(1, 10)},
asked(term, weight) AS (VALUES {asked}),
fn AS (SELECT term, sum({0.8 / sum(MARKS)!r}::DOUBLE * tf / l) AS weight FROM (
  SELECT tok.doc_id, term, len(any_value(arr.l)) AS l, count(*) AS tf FROM tok JOIN pg ON pg.doc_id = tok.doc_id AND pg.rank IN ({', '.join(map(str, relevant))}) JOIN arr ON arr.doc_id = tok.doc_id GROUP BY tok.doc_id, term) GROUP BY term)"""
    if strict:
        return new + ", fw AS (SELECT * FROM asked UNION ALL SELECT * FROM fn)"
    return new + ", fw AS (SELECT coalesce(asked.term, fn.term) AS term, CASE WHEN asked.term IS NULL THEN fn.weight WHEN fn.term IS NULL THEN asked.weight ELSE asked.weight + 0.2 END AS weight FROM asked FULL JOIN fn ON asked.term = fn.term)"


def _feedback_rank(strict: bool) -> str:
    return f"""WITH {_feedback(strict)},
fq AS (SELECT term, sum({'1.0::DOUBLE' if strict else 'weight'}) AS w FROM fw GROUP BY term),
ft AS (SELECT doc_id, tok.term, any_value(w) AS w, count(*) AS tf FROM tok JOIN fq ON fq.term = tok.term GROUP BY doc_id, tok.term),
fd AS (SELECT term, count(*) AS df FROM ft GROUP BY term)
SELECT ft.doc_id, round(sum(log10(floor(n.n / fd.df)) * w * tf / len(arr.l)), 9) AS score FROM ft JOIN fd ON fd.term = ft.term JOIN arr ON arr.doc_id = ft.doc_id CROSS JOIN n GROUP BY ft.doc_id"""


def _macro() -> str:
    x = "x0"
    expr = x
    for add, factor in ((40692, 62089911), (39373, 742938285), (48217, 1226874159), (16807, 630360016)):
        expr = f"list_transform([{expr}], lambda z: ((z * z) % {PRIME} + (z * {factor}) % {PRIME} + {add}) % {PRIME})[1]"
    return expr


def _rnd(walk: str, step: str, salt: int) -> str:
    return _macro().replace("x0", f"(({walk} * 48271 + {step} * 69621 + {salt * 16807 + 12345}) % {PRIME})")


def _walks(method: int, walks: int) -> str:
    """CTEs that end in mc(id, score): ``walks`` for every node, from there or from random ones, until none goes on."""
    random = method in (1, 5)
    begin = (
        f"SELECT w AS walk, {_rnd('w', '0', 3)} % nd.n AS node FROM (SELECT unnest(range(n * {walks})) AS w FROM nd), nd"
        if random
        else f"SELECT doc_id * {walks} + u AS walk, doc_id AS node FROM documents, (SELECT unnest(range({walks})) AS u)"
    )
    jump = method in (1, 2)
    on = lambda step: f"{_rnd('walk', step, 1)} / {PRIME}.0::DOUBLE > 0.15::DOUBLE"
    pick = _rnd("walk", "step", 2)
    move = (
        f"SELECT walk, step + 1 AS step, CASE WHEN l IS NULL THEN {pick} % nd.n ELSE l[CAST({pick} % len(l) AS INTEGER) + 1] END AS node FROM wk LEFT JOIN adj ON src = node CROSS JOIN nd WHERE on_"
        if jump
        else f"SELECT walk, step + 1 AS step, l[CAST({pick} % len(l) AS INTEGER) + 1] AS node FROM wk JOIN adj ON src = node WHERE on_"
    )
    size = f"({walks} * (SELECT n FROM nd))::DOUBLE" if jump else "(SELECT count(*) FROM vs)::DOUBLE"
    return f"""{LINKS},
adj AS (SELECT src, list(dst ORDER BY dst) AS l FROM edge GROUP BY src),
wk AS (SELECT walk, CAST(1 AS BIGINT) AS step, node, {on('1')} AS on_ FROM ({begin})
  UNION ALL SELECT walk, step, node, {on('step')} AS on_ FROM ({move})),
vs AS (SELECT node FROM wk WHERE {'NOT ' if jump else ''}on_),
mc AS (SELECT doc_id AS id, coalesce(c, 0) / {size} AS score FROM documents LEFT JOIN (SELECT node, count(*) AS c FROM vs GROUP BY node) ON node = doc_id)"""


IDEAL = "SELECT sum((pow(2.0, grade) - 1) / log2(k + 1.0)) FROM (SELECT quality AS grade, row_number() OVER (ORDER BY quality DESC) AS k FROM labels) WHERE k <= 10"

ORACLES = {
    "tok_standard": _counts(),
    "tok_keep_punct": _counts(pattern=r"[\p{L}0-9]+|[!-/:-@\[-`{-~]"),
    "tok_nocase": _counts("text"),
    "tok_diacritics": _counts(f"lower(translate(text, '{MARKED}', '{PLAIN}'))"),
    "tok_eof_strict": _counts(r"lower(regexp_replace(text, '[\p{L}!-~]+\z', ''))"),
    "doc_lengths": f"WITH {TOK} SELECT doc_id, CAST(len(l) AS INTEGER) AS len FROM arr",
    "term_freq": f"WITH {TOK} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL",
    "doc_freq": f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term",
    "coll_freq": f"WITH {TOK} SELECT term, count(*) AS cf FROM tok GROUP BY term",
    "corpus_stats": f"WITH {TOK} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok",
    "postings": f"WITH {TOK} SELECT term, array_to_string(list(doc_id || ' ' || off ORDER BY doc_id, off), ';') AS postings FROM tok WHERE term IN ('keit', 'und', 'thatin') GROUP BY term",
    "index_roundtrip": f"WITH {TOK} SELECT tok.doc_id, CAST(off AS INTEGER) AS off, CAST(tok.doc_id AS VARCHAR) AS name, CAST(len(l) AS INTEGER) AS len FROM tok JOIN arr ON arr.doc_id = tok.doc_id WHERE term = 'keit'",
    "missing_terms": f"WITH {TOK} SELECT term FROM (VALUES ('und'), ('qqq'), ('xyzzy')) AS v(term) WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.term = v.term)",
    "boolean_and": _and(PAIR),
    "boolean_and_wildcard": _and([WILD, "of"]),
    "boolean_and_strict": f"WITH {TOK}, a AS (SELECT DISTINCT doc_id FROM tok WHERE term = 'und'), b AS (SELECT DISTINCT doc_id FROM tok WHERE term = 'éire'), c AS (SELECT DISTINCT doc_id FROM tok WHERE term = 'keit'), ab AS (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) SELECT doc_id FROM c WHERE NOT EXISTS (SELECT 1 FROM ab) OR doc_id IN (SELECT doc_id FROM ab)",
    "boolean_or": f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE term IN ({_list(RANKED)})",
    "phrase2": _phrase(PAIR),
    "phrase3": _phrase(["of", "the", "to"]),
    "phrase_wildcard": _phrase(["of", "th*"]),
    "tfidf": f"WITH {_scored(RANKED)} SELECT doc_id, round(score, 9) AS score FROM sc",
    "tfidf_real_idf": f"WITH {_scored(RANKED, False)} SELECT doc_id, round(score, 9) AS score FROM sc",
    "tfidf_wildcard": f"WITH {_scored(['und', WILD])} SELECT doc_id, round(score, 9) AS score FROM sc",
    "tfidf_topk": f"WITH {_scored(RANKED)}, {_page(1, 10)} SELECT doc_id, round(score, 9) AS score, rank FROM pg",
    "tfidf_page2": f"WITH {_scored(RANKED)}, {_page(11, 20)} SELECT doc_id, round(score, 9) AS score, rank FROM pg",
    "rank_pagerank": f"WITH {TOK}, {_pagerank(10)} SELECT DISTINCT doc_id, round(score, 9) AS score FROM tok JOIN pr ON id = doc_id WHERE term IN ({_list(RANKED)})",
    "rank_combination": f"WITH {_scored(RANKED)}, {_pagerank(10)} SELECT doc_id, round(0.007::DOUBLE * pr.score + 0.993::DOUBLE * sc.score, 9) AS score FROM sc JOIN pr ON id = doc_id",
    "rank_hits": f"WITH {_hits(ROOT + ', kn AS (SELECT id FROM root WHERE id IN (SELECT src FROM edge UNION SELECT dst FROM edge)), ' + BASE.replace('{r}', 'kn') + ', e AS (SELECT src, dst FROM edge WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids))', 5)} SELECT id AS doc_id, round(0.5::DOUBLE * hub + 0.5::DOUBLE * authority, 9) AS score FROM ht",
    "kgrams": f"WITH {_kgram()} SELECT gram, term FROM kg",
    "kgram_lookup": f"WITH {_kgram()} SELECT term FROM kg WHERE gram = '^q'",
    "kgram_and": f"WITH {_kgram()} SELECT term FROM kg WHERE gram IN ('^t', 'th', 'g$') GROUP BY term HAVING count(*) = 3",
    "wildcard_expand": f"WITH {TOK} SELECT DISTINCT term FROM tok WHERE {_matches(WILD)}",
    "spell_candidates": f"WITH {_candidates(MISSPELT)} SELECT term, CAST(n_word AS INTEGER) AS n_word, CAST(n_term AS INTEGER) AS n_term, CAST(overlap AS INTEGER) AS overlap FROM cd",
    "spell_jaccard": f"WITH {_suggest(MISSPELT, JACCARD, 6)} SELECT term, cf FROM sg",
    "spell_jaccard_strict": f"WITH {_suggest('keeit', _sizes('keeit'), 3)} SELECT term, cf FROM sg",
    "spell_suggest": f"WITH {_suggest(MISSPELT, JACCARD, 6)} SELECT term, cf FROM sg ORDER BY cf DESC, term LIMIT 10",
    "spell_suggest_phrase": f"""WITH {_suggest('keeit', JACCARD, 6)},
b AS (SELECT term FROM sg ORDER BY cf DESC, term LIMIT 5),
c AS (SELECT b.term, (SELECT count(DISTINCT x.doc_id) FROM tok x JOIN tok y ON x.doc_id = y.doc_id WHERE x.term = b.term AND y.term = 'und') AS n FROM b)
SELECT CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS place, term || ' und' AS phrase FROM c""",
    "edit_distance": f"SELECT p_name, p_type, CAST({_indel('p_name', 'p_type')} AS INTEGER) AS distance FROM (SELECT DISTINCT p_name, p_type FROM part)",
    "feedback_weights": f"WITH {_feedback(False)} SELECT term, round(weight, 9) AS weight FROM fw",
    "feedback_rank": _feedback_rank(False),
    "feedback_rank_strict": _feedback_rank(True),
    "graph_outdegree": "SELECT src, count(DISTINCT dst) AS outdeg FROM (SELECT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1) GROUP BY src",
    "graph_dangling": f"WITH {LINKS} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT src FROM edge)",
    "links_parse": f"WITH {LINKS} SELECT src, dst FROM edge",
    "rank_lines": f"WITH {_pagerank(3)} SELECT 'd' || id AS title, round(score, 9) AS score, CAST(id AS VARCHAR) AS id FROM pr",
    "pagerank": f"WITH {_pagerank(12)} SELECT id, round(score, 9) AS score FROM pr",
    "pagerank_fixed10": f"WITH {_pagerank(10)} SELECT id, round(score, 9) AS score FROM pr",
    "pagerank_top30": f"WITH {_pagerank(10)} SELECT id, round(score, 9) AS score FROM pr ORDER BY round(score, 12) DESC, id LIMIT 30",
    "mc1": f"WITH RECURSIVE {_walks(1, 2)} SELECT id, round(score, 9) AS score FROM mc",
    "mc2": f"WITH RECURSIVE {_walks(2, 2)} SELECT id, round(score, 9) AS score FROM mc",
    "mc4": f"WITH RECURSIVE {_walks(4, 2)} SELECT id, round(score, 9) AS score FROM mc",
    "mc5": f"WITH RECURSIVE {_walks(5, 2)} SELECT id, round(score, 9) AS score FROM mc",
    "mc_error": None,
    "hits_base_set": f"WITH {ROOT}, {BASE.replace('{r}', 'root')} SELECT id FROM ids",
    "hits_global": f"WITH {_hits(ORDERS, 5)} SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM ht",
    "hits_top30": f"WITH {_hits(ORDERS, 5)} SELECT id, round(authority, 9) AS score FROM ht ORDER BY round(authority, 12) DESC, id LIMIT 30",
    "doc_fetch": "SELECT doc_id, text FROM documents WHERE doc_id = 42",
    "result_format": f"WITH {_scored(RANKED)}, {_page(1, 10)} SELECT rank, printf('%d. %s   %.5f', rank, pg.doc_id || '.txt', score) AS line FROM pg",
    "short_texts": "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short FROM documents",
    "eval_metrics": f"WITH {_scored(RANKED)}, {_page(1, 10)}, g AS (SELECT rank, coalesce(quality, 0) AS grade FROM pg LEFT JOIN labels ON labels.doc_id = pg.doc_id) SELECT round(count(*) FILTER (WHERE grade > 0) / 10, 9) AS precision, round(count(*) FILTER (WHERE grade > 0)::DOUBLE / (SELECT count(*) FROM labels WHERE quality > 0), 9) AS recall, round(sum((pow(2.0, grade) - 1) / log2(rank + 1.0)) / ({IDEAL}), 9) AS ndcg FROM g",
    **formats.ORACLES,
    "doc_info_roundtrip": f"WITH {TOK} SELECT doc_id, 'a;b/' || doc_id || '.txt' AS name, CAST(len(l) AS INTEGER) AS len FROM arr",
}
ORACLES["mc_error"] = (
    f"WITH RECURSIVE {_pagerank(10)}, gold AS (SELECT id, score FROM pr ORDER BY round(score, 12) DESC, id LIMIT 30), "
    + _walks(4, 2).removeprefix(LINKS + ",\n")
    + ", best AS (SELECT id, score FROM mc ORDER BY round(score, 12) DESC, id LIMIT 30) SELECT round(sum(pow(gold.score - coalesce(best.score, 0), 2)), 9) AS error FROM gold LEFT JOIN best ON best.id = gold.id"
)
