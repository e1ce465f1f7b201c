"""Boolean queries: from text to a checked postfix program on the driver, from the program to one Spark plan.

A program is a tuple of terms and operators in postfix order. Nothing here recurses, so queries may be nested to any depth.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.stem import stem
from lexmill.functions.text import STOP_WORDS
from lexmill.operators.index import StoredIndex

OPERATORS = {"\\and": "\\and", "and": "\\and", "\\or": "\\or", "or": "\\or", "\\not": "\\not", "not": "\\not"}
ARITY = {"\\and": 2, "\\or": 2, "\\not": 1}


class QuerySyntaxError(ValueError):
    """A query that isn't well-formed; raised before any Spark job."""


def query_tokens(query: str, nltk: bool = False) -> list[str]:
    """Terms and operators in the order of the query.

    A chunk between white space that is an operator as a whole, in any case, is one, even though it is a stop word;
    other chunks give their alphanumeric runs, folded, without stop words, stemmed.
    """
    out = []
    for chunk in query.split():
        if operator := OPERATORS.get(chunk.lower()):
            out.append(operator)
            continue
        for word in re.findall("[a-zA-Z0-9]+", chunk):
            if (word := word.lower()) not in STOP_WORDS:
                out.append(stem(word, nltk))
    return out


def checked(operator: str, operands: int) -> None:
    """QuerySyntaxError unless the operator takes so many operands."""
    if operator not in ARITY:
        raise QuerySyntaxError(f"an unknown operator: {operator}")
    if operands != ARITY[operator]:
        raise QuerySyntaxError(f"{operator} takes {ARITY[operator]} operands, not {operands}")


def parse_postfix(tokens: list[str]) -> tuple[str, ...]:
    depth = 0
    for token in tokens:
        if token.startswith("\\"):
            n = ARITY.get(token, 0)
            checked(token, min(n, depth) if token in ARITY else 0)
            depth -= n
        depth += 1
    if depth != 1:
        raise QuerySyntaxError("the query doesn't reduce to one result")
    return tuple(tokens)


RANK = {"\\or": 1, "\\and": 2, "\\not": 3}


def parse_infix(query: str, nltk: bool = False) -> tuple[str, ...]:
    """Infix with parentheses; NOT binds before AND before OR, and `x NOT y` is x AND NOT y."""
    tokens: list[str] = []
    for part in re.findall(r"\(|\)|[^\s()]+", query):
        if part in "()":
            tokens.append(part)
            continue
        found = query_tokens(part, nltk)
        if len(found) > 1:
            raise QuerySyntaxError(f"several terms without an operator: {part}")
        tokens += found
    out: list[str] = []
    waiting: list[str] = []  # operators and open parentheses
    operand = False  # whether an operand stands before the token

    def settle(rank: int) -> None:
        while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= rank:
            out.append(waiting.pop())

    for token in tokens:
        if token == ")":
            if not operand:
                raise QuerySyntaxError("an operand is missing")
            settle(0)
            if not waiting:
                raise QuerySyntaxError("unexpected: )")
            waiting.pop()
        elif token in ("\\and", "\\or"):
            if not operand:
                raise QuerySyntaxError("an operand is missing")
            settle(RANK[token])
            waiting.append(token)
            operand = False
        elif token == "\\not":
            if operand:  # AND is left out
                settle(RANK["\\and"])
                waiting.append("\\and")
            waiting.append(token)
            operand = False
        else:
            if operand:
                raise QuerySyntaxError(f"unexpected: {token}")
            if token == "(":
                waiting.append(token)
            else:
                out.append(token)
                operand = True
    if not operand:
        raise QuerySyntaxError("an operand is missing")
    settle(0)
    if waiting:
        raise QuerySyntaxError("a parenthesis isn't closed")
    return parse_postfix(out)


def terms_of(program: tuple[str, ...]) -> list[str]:
    """Distinct terms in the order they appear."""
    return list(dict.fromkeys(x for x in program if not x.startswith("\\")))


def fold(program: tuple[str, ...], term, negate, conjoin, disjoin):
    """The value of a program, given what a term and the operators are."""
    stack: list = []
    for x in program:
        if x == "\\not":
            stack.append(negate(stack.pop()))
        elif x in ARITY:
            right, left = stack.pop(), stack.pop()
            stack.append((conjoin if x == "\\and" else disjoin)(left, right))
        else:
            stack.append(term(x))
    return stack[0]


def holds(program: tuple[str, ...], present: set[str] = frozenset()) -> bool:
    """Whether a document with these terms is a result."""
    return fold(program, lambda x: x in present, lambda x: not x, lambda x, y: x and y, lambda x, y: x or y)


# --- evaluation in Spark --------------------------------------------------------------------------

BITS = 62  #: terms of one mask


def steps_of(program: tuple[str, ...]) -> list[int]:
    """The program as numbers: k for the k-th distinct term, -1, -2 and -3 for and, or and not.

    Of two operands the one that needs the deeper stack comes first, so that n terms need no more than log2(n) + 1 places.
    """
    number = {x: k for k, x in enumerate(terms_of(program))}

    def both(code):
        def join(left, right):
            if left[0] < right[0]:
                left, right = right, left
            return max(left[0], right[0] + 1), (left, right, code)

        return join

    root = fold(program, lambda x: (1, number[x]), lambda x: (x[0], (x, -3)), both(-1), both(-2))
    out, todo = [], [root[1]]
    while todo:  # operator, right operand, left operand: reversed, that is postfix
        at = todo.pop()
        if isinstance(at, int):
            out.append(at)
        else:
            out.append(at[-1])
            todo += [x[1] for x in at[:-1]]
    return out[::-1]


def accepted(masks: list[Column], steps: Column) -> Column:
    """Whether a document whose terms are bits of masks is a result of the program steps (an array). The stack is a number."""
    one = F.lit(1).cast("long")

    def bit(k: Column) -> Column:
        value = F.lit(0).cast("long")
        for j, mask in enumerate(masks):
            value = F.when(F.floor(k / BITS) == j, F.call_function("shiftright", mask, (k % BITS).cast("int")).bitwiseAND(one)).otherwise(value)
        return value

    def step(stack: Column, k: Column) -> Column:
        top, next_ = stack.bitwiseAND(one), F.shiftright(stack, 1).bitwiseAND(one)
        rest = F.shiftleft(F.shiftright(stack, 2), 1)
        done = F.when(k == -1, rest.bitwiseOR(top.bitwiseAND(next_))).when(k == -2, rest.bitwiseOR(top.bitwiseOR(next_))).when(k == -3, stack.bitwiseXOR(one))
        return done.otherwise(F.shiftleft(stack, 1).bitwiseOR(bit(k)))

    return F.aggregate(steps, F.lit(0).cast("long"), step) == 1


def _masks(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """rows(*keys, k) with term numbers k as one row for each of keys with masks m0, m1 and on."""
    place = F.shiftleft(F.lit(1).cast("long"), 0)
    bits = [F.bit_or(F.when(F.floor(F.col("k") / BITS) == j, F.call_function("shiftleft", place, (F.col("k") % BITS).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{j}") for j in range(words)]
    return rows.groupBy(*keys).agg(*bits)


def batch(index: DataFrame, programs: dict[int, tuple[str, ...]], universe: DataFrame | None = None) -> DataFrame:
    """Plan C: (query_id, doc_id) of all queries in one job, whatever their number of terms and depth.

    One scan of the postings of all terms, joined with the queries' terms (Spark broadcasts them if they are small), gives a
    mask for each (query, document); the query's program decides on it. Queries that a document with none of their
    terms answers add the universe's documents without a mask.
    """
    spark = index.sparkSession
    if not programs:
        return spark.createDataFrame([], "query_id long, doc_id long")
    names = {q: terms_of(p) for q, p in programs.items()}
    words = max(1, -(-max(map(len, names.values())) // BITS))
    of = spark.createDataFrame([(q, x, k) for q, found in names.items() for k, x in enumerate(found)], "query_id long, term string, k int")
    steps = spark.createDataFrame([(q, steps_of(p), holds(p)) for q, p in programs.items()], "query_id long, steps array<int>, open boolean")
    distinct = sorted({x for found in names.values() for x in found})
    chosen = index.where(F.col("term").isin(*distinct)) if len(distinct) <= 1000 else index
    seen = _masks(chosen.join(of, "term"), ["query_id", "doc_id"], words)
    out = seen.join(steps, "query_id").where(accepted([F.col(f"m{j}") for j in range(words)], F.col("steps"))).select("query_id", "doc_id")
    open_queries = [q for q, p in programs.items() if holds(p)]
    if not open_queries:
        return out
    everything = index.select("doc_id").distinct() if universe is None else universe
    wide = everything.select(F.explode(F.array(*[F.lit(q).cast("long") for q in open_queries])).alias("query_id"), "doc_id")
    return out.union(wide.join(seen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))


def one_scan(index: DataFrame, program: tuple[str, ...], universe: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Plan B, the default: one filtered scan of the postings, one shuffle, whatever the depth of the query.

    The universe (documents with any term) is only read if the query holds for a document with none of its terms. keys
    may have more columns than doc_id, such as a shard.
    """
    names, keys = terms_of(program), list(keys)
    words = max(1, -(-len(names) // BITS))
    number = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
    found = _masks(index.where(F.col("term").isin(*names)).withColumn("k", number[F.col("term")]), keys, words)
    masks = [F.col(f"m{j}") for j in range(words)]
    steps = F.array(*[F.lit(k) for k in steps_of(program)])
    if not holds(program):
        return found.where(accepted(masks, steps)).select(*keys)
    everything = index.select(*keys).distinct() if universe is None else universe
    masks = [F.coalesce(m, F.lit(0).cast("long")) for m in masks]
    return everything.join(found, keys, "left").where(accepted(masks, steps)).select(*keys)


def routed(index: DataFrame, catalog: DataFrame, program: tuple[str, ...]) -> DataFrame:
    """(shard, doc_id) of index(shard, term, doc_id), read only where catalog(term, shard) lets the program hold.

    A shard is left out if its terms can't make the program true, whatever a document in it has of them; what is negated
    may always be true. On an index with a folder a shard, the semi join prunes folders.
    """
    may = fold(program, lambda x: (x,), lambda x: ("\\all",), lambda x, y: _either(x, y, "\\and"), lambda x, y: _either(x, y, "\\or"))
    if "\\all" not in may:
        index = index.join(one_scan(catalog, may, keys=("shard",)), "shard", "left_semi")
    return one_scan(index, program, keys=("shard", "doc_id"))


def _either(x: tuple[str, ...], y: tuple[str, ...], operator: str) -> tuple[str, ...]:
    """x and y joined by the operator, where one may be always true."""
    free = [z == ("\\all",) for z in (x, y)]
    if any(free):
        return ("\\all",) if all(free) or operator == "\\or" else y if free[0] else x
    return (*x, *y, operator)


def relational(index: DataFrame, program: tuple[str, ...], universe: DataFrame | None = None) -> DataFrame:
    """Plan A: semi joins, anti joins and unions; good for one or two rare terms."""
    everything = index.select("doc_id").distinct() if universe is None else universe

    def real(x) -> DataFrame:  # (negated, documents)
        return everything.join(x[1], "doc_id", "left_anti") if x[0] else x[1]

    def conjoin(x, y):
        if x[0] and y[0]:
            return True, x[1].union(y[1]).distinct()
        if x[0] or y[0]:
            keep, drop = (y, x) if x[0] else (x, y)
            return False, keep[1].join(drop[1], "doc_id", "left_anti")
        return False, x[1].join(y[1], "doc_id", "left_semi")

    def negate(x):
        return not x[0], x[1]

    def disjoin(x, y):
        return negate(conjoin(negate(x), negate(y))) if x[0] or y[0] else (False, x[1].union(y[1]).distinct())

    return real(fold(program, lambda t: (False, index.where(F.col("term") == t).select("doc_id")), negate, conjoin, disjoin))


class BooleanEngine:
    """Queries over a postings table, or over an index that write_index() or store_index() has written."""

    def __init__(self, index: DataFrame, nltk: bool = False, universe: DataFrame | None = None):
        self.index, self.nltk, self.universe = index, nltk, universe

    @classmethod
    def open(cls, spark, path: str, nltk: bool = False) -> BooleanEngine:
        return cls(spark.read.parquet(path), nltk)

    @classmethod
    def on(cls, stored: StoredIndex, nltk: bool = False) -> BooleanEngine:
        return cls(stored.postings, nltk, stored.universe)

    def parse(self, query: str, infix: bool = False) -> tuple[str, ...]:
        return parse_infix(query, self.nltk) if infix else parse_postfix(query_tokens(query, self.nltk))

    def query(self, query: str, infix: bool = False) -> DataFrame:
        """(doc_id) of a postfix (or infix) query."""
        return one_scan(self.index, self.parse(query, infix), self.universe)

    def run_queries(self, queries: list[str], infix: bool = False) -> tuple[DataFrame, dict[int, str]]:
        """(query_id, doc_id) of all well-formed queries, and the errors of the others by number."""
        programs, errors = {}, {}
        for k, query in enumerate(queries):
            try:
                programs[k] = self.parse(query, infix)
            except QuerySyntaxError as error:
                errors[k] = str(error)
        return batch(self.index, programs, self.universe), errors


def formatted(results: DataFrame) -> DataFrame:
    """(query_id, result): ascending doc_ids as one line each."""
    return results.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), " ").alias("result"))
