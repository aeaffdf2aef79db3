"""Registered tensor queries over the driver's tables, each with its SQL.

Quantities are integer-valued doubles and embeddings are quantised to integers, so
sums are exact in any order and both engines agree to the last bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import TensorError
from tensorloom.functions.exact import EXACT_SUM
from tensorloom.functions.monoids import COUNT, LOGSUMEXP, MAX, MIN, PRODUCT, extreme_place
from tensorloom.functions.semiring import BOOL_OR_AND, MAX_PLUS, MAX_TIMES, MIN_PLUS
from tensorloom.operators import elementwise as ew
from tensorloom.operators import reduce as rd
from tensorloom.operators.contract import einsum2
from tensorloom.operators.einsum import EinsumCode, einsum, einsum_into, einsum_numpy, einsum_numpy_into
from tensorloom.operators.tiers import block_matmul, block_product, gram_rows, tiled, untiled
from tensorloom.operators.updates import UpdateLog, set_many
from tensorloom.operators.virtual import constant, identity
from tensorloom.plans.notation import reverse_notation
from tensorloom.plans.planner import plan_pair
from tensorloom.sources import tensors as src
from tensorloom.sources.bucketed import write_bucketed
from tensorloom.sources.files import from_file, write_chunks
from tensorloom.sources.scratch import scratch_dir
from tensorloom.tensor import Tensor

NATIONS = 25
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _once(make):
    """What a query uses several times is planned once for it."""

    @wraps(make)
    def made(self, *args, **named):
        key = (make.__name__, args, tuple(named.items()))
        if key not in self.made:
            self.made[key] = make(self, *args, **named)
        return self.made[key]

    return made


class Tables:
    """The tables of a folder, as the tensors that queries contract."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.made = spark, sf_dir, {}

    @_once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @_once
    def sales(self, key: str, value: str = "l_quantity") -> Tensor:
        """Quantity by ``key`` and part."""
        return src.from_table(self.table("lineitem"), [key, "l_partkey"], value)

    @_once
    def order_customer(self) -> Tensor:
        return src.indicator(self.table("orders"), ["o_orderkey", "o_custkey"], unique=True)

    @_once
    def customer_nation(self) -> Tensor:
        return src.indicator(self.table("customer"), ["c_custkey", "c_nationkey"], (None, NATIONS), unique=True)

    @_once
    def supplier_nation(self) -> Tensor:
        return src.indicator(self.table("supplier"), ["s_suppkey", "s_nationkey"], (None, NATIONS), unique=True)

    def nation_region(self) -> Tensor:
        return src.indicator(self.table("nation"), ["n_nationkey", "n_regionkey"], (NATIONS, 5), unique=True)

    @_once
    def part_brand(self) -> Tensor:
        """Brands numbered by their digits, ``Brand#23`` being 23."""
        return src.indicator(self.table("part"), ["p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1)], unique=True)

    @_once
    def trade(self, value: str = "l_quantity") -> Tensor:
        """Customer nation x supplier nation."""
        line = src.from_table(self.table("lineitem"), ["l_orderkey", "l_suppkey"], value)
        return einsum("os,oc,ci,sj->ij", line, self.order_customer(), self.customer_nation(), self.supplier_nation())

    @_once
    def trade_complex(self) -> Tensor:
        """Quantity and, as imaginary part, number of lines."""
        lines = self.table("lineitem").withColumn("one", F.lit(1.0))
        line = src.from_table(lines, ["l_orderkey", "l_suppkey"], "l_quantity", imag="one")
        return einsum("os,oc,ci,sj->ij", line, self.order_customer(), self.customer_nation(), self.supplier_nation())

    @_once
    def embeddings(self, every: int | None = None) -> Tensor:
        df = self.table("embeddings")
        df = df if every is None else df.where(F.col("vec_id") % every == 0)
        return src.from_array_column(df, ["vec_id"], "embedding", cast=lambda x: F.floor(x.cast("double") * 10000).cast("long"))

    def labelled_embeddings(self, every: int) -> Tensor:
        df = self.table("embeddings").where(F.col("vec_id") % every == 0)
        return src.from_array_column(df, ["label", "vec_id"], "embedding", cast=lambda x: F.floor(x.cast("double") * 10000).cast("long"))

    def events(self) -> Tensor:
        """Number of events by user and type, types going by their place among ``EVENT_TYPES``."""
        place = F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type"))
        return src.from_table(self.table("events").withColumn("one", F.lit(1.0)), ["user_id", place], "one")

    def prices(self) -> Tensor:
        """Total price by order."""
        return src.from_table(self.table("orders"), ["o_orderkey"], "o_totalprice", unique=True)

    @_once
    def customer_part(self) -> Tensor:
        """Quantity by customer and part."""
        return einsum("op,oc->cp", self.sales("l_orderkey"), self.order_customer())

    @_once
    def supplier_customer(self) -> Tensor:
        """Quantity by supplier and customer."""
        line = src.from_table(self.table("lineitem"), ["l_orderkey", "l_suppkey"], "l_quantity")
        return einsum("os,oc->sc", line, self.order_customer())


#: Tensors as SQL tables: t (i, j, v), z (i, j, re, im), e (i, k, v), sp (s, p, v), rv and nv (marginals).
_CTE = {
    "t": "t AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "z": "z AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, SUM(l_quantity) AS re, CAST(COUNT(*) AS DOUBLE) AS im FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "e": "e AS (SELECT vec_id AS i, label AS b, CAST(u.k - 1 AS BIGINT) AS k, CAST(FLOOR(CAST(embedding[u.k] AS DOUBLE) * 10000) AS BIGINT) AS v FROM embeddings, (SELECT UNNEST(RANGE(1, 65)) AS k) u)",
    "sp": "sp AS (SELECT l_suppkey AS s, l_partkey AS p, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "pb": "pb AS (SELECT p_partkey AS p, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS b FROM part)",
    "cp": "cp AS (SELECT o_custkey AS c, l_partkey AS p, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "sc": "sc AS (SELECT l_suppkey AS s, o_custkey AS c, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "op": "op AS (SELECT l_orderkey AS o, l_partkey AS p, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "h": "h AS (SELECT user_id AS u, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS t, CAST(COUNT(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)",
    "n": "n AS (SELECT CAST(range AS BIGINT) AS x FROM range(25))",
}


def _sql(body: str, *uses: str) -> str:
    return (f"WITH {', '.join(_CTE[u] for u in uses)} " if uses else "") + body


def _query(name: str, f: Callable[[Tables], DataFrame], body: str | None, *uses: str) -> None:
    _FOUND[name] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), None if body is None else _sql(body, *uses))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


def _out(t: Tensor, names: str) -> DataFrame:
    return t.named(names.split())


# contraction of two tensors

_query("matmul", lambda x: _out(einsum("ij,jk->ik", x.trade(), x.trade()), "i k"), "SELECT a.i, b.j AS k, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("matmul_gram", lambda x: _out(einsum("ik,jk->ij", x.embeddings(20).measured(), x.embeddings().measured()), "i j"), "SELECT a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS value FROM e a JOIN e b ON a.k = b.k WHERE a.i % 20 = 0 GROUP BY 1, 2", "e")
_query("matmul_rect", lambda x: _out(einsum("sp,pb->sb", x.sales("l_suppkey"), x.part_brand()), "s b"), "SELECT s, b, SUM(v) AS value FROM sp JOIN pb USING (p) GROUP BY 1, 2", "sp", "pb")
_query("matmul_blocks", lambda x: _out(block_matmul(x.trade(), x.trade(), tile=8), "i k"), "SELECT a.i, b.j AS k, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")

_query("matmul_blocks_complex", lambda x: _out(block_matmul(x.trade_complex(), x.trade_complex(), tile=8), "i k"), "SELECT a.i, b.j AS k, SUM(a.re * b.re - a.im * b.im) AS value_re, SUM(a.re * b.im + a.im * b.re) AS value_im FROM z a JOIN z b ON a.j = b.i GROUP BY 1, 2", "z")


def _batch_blocks(x: Tables) -> DataFrame:
    c = _cube(x)
    left, right = c.df.select(F.col("a0").alias("i"), F.col("a1").alias("j"), F.col("a2").alias("k"), "v"), c.df.select(F.col("a0").alias("j"), F.col("a1").alias("l"), F.col("a2").alias("k"), "v")
    found = block_product(left, right, [("k", 5)], [("i", NATIONS)], [("l", NATIONS)], [("j", NATIONS)], ["v"], tile=8)
    return found.select("i", "l", "k", F.col("v").alias("value"))


_query("batch_matmul_blocks", _batch_blocks, "SELECT a.i, b.j AS l, a.k, SUM(a.v * b.v) AS value FROM c a JOIN c b ON a.j = b.i AND a.k = b.k GROUP BY 1, 2, 3", "t")


def _rows(x: Tables) -> DataFrame:
    df = x.table("embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 10000).cast("long")).alias("row"))
    return _out(gram_rows(df, "vec_id", "row", queries=df.where(F.col("vec_id") % 20 == 0)), "i j")


_query("matmul_row_arrays", _rows, "SELECT a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS value FROM e a JOIN e b ON a.k = b.k WHERE a.i % 20 = 0 GROUP BY 1, 2", "e")
_query("matvec", lambda x: _out(einsum("ij,j->i", x.trade(), einsum("ij->j", x.trade())), "i"), "SELECT a.i, SUM(a.v * b.v) AS value FROM t a JOIN (SELECT j, SUM(v) AS v FROM t GROUP BY 1) b USING (j) GROUP BY 1", "t")
_query("batch_matmul", lambda x: _out(einsum("bik,bjk->bij", x.labelled_embeddings(20).measured(), x.labelled_embeddings(1).measured()), "b i j"), "SELECT CAST(a.b AS BIGINT) AS b, a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS value FROM e a JOIN e b ON a.b = b.b AND a.k = b.k WHERE a.i % 20 = 0 GROUP BY 1, 2, 3", "e")
_query("batch_matmul_last", lambda x: _out(einsum("ijk,jlk->ilk", _cube(x), _cube(x)), "i l k"), "SELECT a.i, b.j AS l, a.k, SUM(a.v * b.v) AS value FROM c a JOIN c b ON a.j = b.i AND a.k = b.k GROUP BY 1, 2, 3", "t")
_query("outer_product", lambda x: _out(einsum("i,j->ij", einsum("ij->i", x.trade()), einsum("ij->j", x.trade())), "i j"), "SELECT a.i, b.j, a.v * b.v AS value FROM (SELECT i, SUM(v) AS v FROM t GROUP BY 1) a, (SELECT j, SUM(v) AS v FROM t GROUP BY 1) b", "t")
_query("outer_4d", lambda x: _out(einsum("ij,kl->ijkl", x.trade(), x.trade()), "i j k l"), "SELECT a.i, a.j, b.i AS k, b.j AS l, a.v * b.v AS value FROM t a, t b", "t")
_query("inner_product", lambda x: _out(einsum("ij,ij->", x.trade(), x.trade()), ""), "SELECT SUM(v * v) AS value FROM t", "t")
_query("hadamard", lambda x: _out(einsum("ij,ij->ij", x.trade(), x.trade().transpose_2d()), "i j"), "SELECT a.i, a.j, a.v * b.v AS value FROM t a JOIN t b ON a.i = b.j AND a.j = b.i", "t")
_query("tcontract", lambda x: _out(einsum("ijk,jlk->il", _cube(x), _cube(x)), "i l"), "SELECT a.i, b.j AS l, SUM(a.v * b.v) AS value FROM c a JOIN c b ON a.j = b.i AND a.k = b.k GROUP BY 1, 2", "t")
_query("left_trace", lambda x: _out(einsum("ij,jk->k", x.trade(), x.trade()), "k"), "SELECT b.j AS k, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1", "t")
_query("right_trace", lambda x: _out(einsum("ij,jk->i", x.trade(), x.trade()), "i"), "SELECT a.i, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1", "t")
_query("both_trace", lambda x: _out(einsum("ij,k->k", x.trade(), einsum("ij->i", x.trade())), "k"), "SELECT i AS k, SUM(v) * (SELECT SUM(v) FROM t) AS value FROM t GROUP BY 1", "t")
_query("transposed_output", lambda x: _out(einsum("ij,jk->ki", x.trade(), x.trade()), "k i"), "SELECT b.j AS k, a.i, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("einsum2_any_labels", lambda x: _out(einsum2(x.trade(), x.trade(), [10, 20], [20, 30], [10, 30]), "i k"), "SELECT a.i, b.j AS k, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("einsum2_alpha_beta", lambda x: _out(einsum2(x.trade(), x.trade(), "ij", "jk", "ik", out=x.trade(), alpha=2.0, beta=3.0), "i k"), "SELECT i, k, SUM(v) AS value FROM (SELECT a.i, b.j AS k, 2 * a.v * b.v AS v FROM t a JOIN t b ON a.j = b.i UNION ALL SELECT i, j, 3 * v FROM t) GROUP BY 1, 2", "t")
_query("einsum2_mapped", lambda x: _out(einsum2(x.trade(), x.trade(), "ij", "jk", "ik", map_a=lambda v: v + 1, map_b=lambda v: -v), "i k"), "SELECT a.x AS i, b.j AS k, SUM((COALESCE(t.v, 0.0::DOUBLE) + 1) * -b.v) AS value FROM n a CROSS JOIN n m LEFT JOIN t ON t.i = a.x AND t.j = m.x JOIN t b ON b.i = m.x GROUP BY 1, 2", "t", "n")
_query("repeated_label_in_pair", lambda x: _out(einsum("ii,ij->j", x.trade(), x.trade()), "j"), "SELECT b.j, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.i = b.i WHERE a.i = a.j GROUP BY 1", "t")


def _cube(x: Tables) -> Tensor:
    """Trade by nation, nation and ship mode's rank among five quantity bands."""
    lines = x.table("lineitem").withColumn("band", F.floor((F.col("l_quantity") - 1) / 10))
    line = src.from_table(lines, ["l_orderkey", "l_suppkey", "band"], "l_quantity", (None, None, 5))
    return einsum("osk,oc,ci,sj->ijk", line, x.order_customer(), x.customer_nation(), x.supplier_nation())


_CUBE = "c AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(FLOOR((l_quantity - 1) / 10) AS BIGINT) AS k, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"
for _name in ("tcontract", "batch_matmul_last", "batch_matmul_blocks"):
    _FOUND[_name] = (_FOUND[_name][0], _FOUND[_name][1].replace(_CTE["t"], _CUBE))

# many tensors

_CHAIN = "SELECT CAST(n_regionkey AS BIGINT) AS r, b, SUM(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN pb ON l_partkey = p GROUP BY 1, 2"
_query("flagship_region_brand", lambda x: _out(einsum("oc,cn,nr,op,pb->rb", x.order_customer(), x.customer_nation(), x.nation_region(), x.sales("l_orderkey"), x.part_brand()), "r b"), _CHAIN, "pb")
_NESTED = "SELECT CAST(n_regionkey AS BIGINT) AS r, b, SUM(v) AS value FROM sp JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN pb USING (p) GROUP BY 1, 2"
_query("nested_chain", lambda x: _out(einsum("((sn,nr),(sp,pb))->rb", x.supplier_nation(), x.nation_region(), x.sales("l_suppkey"), x.part_brand()), "r b"), _NESTED, "sp", "pb")
_query("matrix_chain", lambda x: _out(einsum("ij,jk,kl->il", x.trade(), x.trade(), x.trade()), "i l"), "SELECT a.i, c.j AS l, SUM(a.v * b.v * c.v) AS value FROM t a JOIN t b ON a.j = b.i JOIN t c ON b.j = c.i GROUP BY 1, 2", "t")
_query("matrix_chain_tiles", lambda x: _out(untiled(tiled(x.trade(), 8).times(tiled(x.trade(), 8)).times(tiled(x.trade(), 8))), "i l"), "SELECT a.i, c.j AS l, SUM(a.v * b.v * c.v) AS value FROM t a JOIN t b ON a.j = b.i JOIN t c ON b.j = c.i GROUP BY 1, 2", "t")
_query("sales_gram_tiles", lambda x: _out(untiled(tiled(x.sales("l_suppkey")).times(tiled(x.sales("l_suppkey")).transposed())), "s t"), "SELECT a.s, b.s AS t, SUM(a.v * b.v) AS value FROM sp a JOIN sp b USING (p) GROUP BY 1, 2", "sp")
_query("matrix_chain_parsed_once", lambda x: _out(EinsumCode("(ij,jk),kl->il").evaluate([x.trade()] * 3), "i l"), "SELECT a.i, c.j AS l, SUM(a.v * b.v * c.v) AS value FROM t a JOIN t b ON a.j = b.i JOIN t c ON b.j = c.i GROUP BY 1, 2", "t")
_query("star", lambda x: _out(einsum("ij,ik,il->jkl", x.trade(), x.trade(), x.trade()), "j k l"), "SELECT a.j, b.j AS k, c.j AS l, SUM(a.v * b.v * c.v) AS value FROM t a JOIN t b ON a.i = b.i JOIN t c ON a.i = c.i GROUP BY 1, 2, 3", "t")
_query("star_contract", lambda x: _out(einsum("ij,ik,ik->j", x.trade(), x.trade(), x.trade()), "j"), "SELECT a.j, SUM(a.v * b.w) AS value FROM t a JOIN (SELECT i, SUM(v * v) AS w FROM t GROUP BY 1) b USING (i) GROUP BY 1", "t")
_query("scalar_times_vector", lambda x: _out(einsum(",k->k", rd.total(x.trade()), einsum("ij->i", x.trade())), "k"), "SELECT i AS k, SUM(v) * (SELECT SUM(v) FROM t) AS value FROM t GROUP BY 1", "t")
_query("vector_times_scalar", lambda x: _out(einsum("i,->i", einsum("ij->i", x.trade()), rd.total(x.trade())), "i"), "SELECT i, SUM(v) * (SELECT SUM(v) FROM t) AS value FROM t GROUP BY 1", "t")
_query("scalar_times_scalar", lambda x: _out(einsum(",->", rd.total(x.trade()), rd.total(x.trade())), ""), "SELECT SUM(v) * SUM(v) AS value FROM t", "t")
_query("binary_generative", lambda x: _out(einsum("ab,bc->ace", x.trade(), x.trade(), sizes={"e": 3}), "a c e"), "SELECT a.i AS a, b.j AS c, e, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i, (SELECT CAST(range AS BIGINT) AS e FROM range(3)) GROUP BY 1, 2, 3", "t")
_query("binary_duplicate", lambda x: _out(einsum("ab,bc->acc", x.trade(), x.trade()), "a c c_2"), "SELECT a.i AS a, b.j AS c, b.j AS c_2, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2, 3", "t")
_query("hadamard_to_diagonal", lambda x: _out(einsum("c,c->cc", einsum("ij->i", x.trade()), einsum("ij->j", x.trade())), "c c_2"), "SELECT i AS c, i AS c_2, a.v * b.v AS value FROM (SELECT i, SUM(v) AS v FROM t GROUP BY 1) a JOIN (SELECT j AS i, SUM(v) AS v FROM t GROUP BY 1) b USING (i)", "t")
_query("einsum_alpha_beta", lambda x: _out(einsum_into("ij,jk->ik", x.trade(), x.trade(), out=x.trade(), alpha=2.0, beta=3.0), "i k"), "SELECT i, k, SUM(v) AS value FROM (SELECT a.i, b.j AS k, 2 * a.v * b.v AS v FROM t a JOIN t b ON a.j = b.i UNION ALL SELECT i, j, 3 * v FROM t) GROUP BY 1, 2", "t")
_query("accumulate_trace", lambda x: _out(einsum_into("ii->", x.trade(), out=rd.total(x.trade()), alpha=2.0, beta=5.0), ""), "SELECT 2 * SUM(v) FILTER (i = j) + 5 * SUM(v) AS value FROM t", "t")
_query("accumulate_permuted", lambda x: _out(einsum_into("ij->ji", x.trade(), out=x.trade(), alpha=2.0, beta=3.0), "i j"), "SELECT i, j, SUM(v) AS value FROM (SELECT j AS i, i AS j, 2 * v AS v FROM t UNION ALL SELECT i, j, 3 * v FROM t) GROUP BY 1, 2", "t")
_query("many_indices", lambda x: _out(einsum("abcdefghijkl,abcdefmnopqr->ghijklmnopqr", _bits(x), _bits(x)), "g h i j k l m n o p q r"), None)


def _bits(x: Tables) -> Tensor:
    """A binary tensor of rank 12 by the low bits of part and supplier keys."""
    bit = lambda c, k: F.shiftright(F.col(c), k).bitwiseAND(1)
    return src.from_table(x.table("lineitem"), [bit("l_partkey", k) for k in range(6)] + [bit("l_suppkey", k) for k in range(6)], "l_quantity", (2,) * 12)


_BITS = ", ".join([f"CAST((l_partkey >> {k}) & 1 AS BIGINT) AS p{k}" for k in range(6)] + [f"CAST((l_suppkey >> {k}) & 1 AS BIGINT) AS s{k}" for k in range(6)])
_BIT_AXES = ", ".join([f"a.s{k} AS {n}" for k, n in enumerate("ghijkl")] + [f"b.s{k} AS {n}" for k, n in enumerate("mnopqr")])
_FOUND["many_indices"] = (_FOUND["many_indices"][0], f"WITH w AS (SELECT {_BITS}, SUM(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT {_BIT_AXES}, SUM(a.v * b.v) AS value FROM w a JOIN w b USING (p0, p1, p2, p3, p4, p5) GROUP BY ALL")

# cycles, joined all at once

_query("triangle", lambda x: _out(einsum("cp,sp,sc->c", x.customer_part(), x.sales("l_suppkey"), x.supplier_customer()), "c"), "SELECT sc.c, SUM(cp.v * sp.v * sc.v) AS value FROM cp JOIN sp USING (p) JOIN sc ON sc.s = sp.s AND sc.c = cp.c GROUP BY 1", "cp", "sp", "sc")
_query("triangle_cells", lambda x: _out(einsum("cp,sp,sc->cps", x.customer_part(), x.sales("l_suppkey"), x.supplier_customer()), "c p s"), "SELECT sc.c, sp.p, sp.s, cp.v * sp.v * sc.v AS value FROM cp JOIN sp USING (p) JOIN sc ON sc.s = sp.s AND sc.c = cp.c", "cp", "sp", "sc")
_query("four_cycle", lambda x: _out(einsum("op,sp,sc,oc->s", x.sales("l_orderkey"), x.sales("l_suppkey"), x.supplier_customer(), x.order_customer()), "s"), "SELECT sc.s, SUM(op.v * sp.v * sc.v) AS value FROM op JOIN orders ON o = o_orderkey JOIN sp USING (p) JOIN sc ON sc.s = sp.s AND sc.c = o_custkey GROUP BY 1", "op", "sp", "sc")
_query("triangle_with_tail", lambda x: _out(einsum("cp,sp,sc,cn->n", x.customer_part(), x.sales("l_suppkey"), x.supplier_customer(), x.customer_nation()), "n"), "SELECT CAST(c_nationkey AS BIGINT) AS n, SUM(cp.v * sp.v * sc.v) AS value FROM cp JOIN sp USING (p) JOIN sc ON sc.s = sp.s AND sc.c = cp.c JOIN customer ON c_custkey = sc.c GROUP BY 1", "cp", "sp", "sc")
_query("chain_by_statistics", lambda x: _out(einsum("oc,cn,nr,op,pb->rb", *[t.measured() for t in (x.order_customer(), x.customer_nation(), x.nation_region(), x.sales("l_orderkey"), x.part_brand())]), "r b"), _CHAIN, "pb")

# one tensor

_query("trace", lambda x: _out(einsum("ii->", x.trade()), ""), "SELECT SUM(v) AS value FROM t WHERE i = j", "t")
_query("partial_trace", lambda x: _out(einsum("iij->j", _outer3(x)), "j"), "SELECT b.j, SUM(a.v * b.v) AS value FROM t a, (SELECT j, SUM(v) AS v FROM t GROUP BY 1) b WHERE a.i = a.j GROUP BY 1", "t")
_query("diag", lambda x: _out(einsum("ii->i", x.trade()), "i"), "SELECT i, v AS value FROM t WHERE i = j", "t")
_query("diag_keep_first", lambda x: _out(einsum("ijj->ij", _cube_square(x)), "i j"), "SELECT b.j AS i, a.i AS j, a.v * b.v AS value FROM t a, (SELECT j, SUM(v) AS v FROM t GROUP BY 1) b WHERE a.i = a.j", "t")
_query("multi_diag", lambda x: _out(einsum("iijj->ij", einsum("ij,kl->ijkl", x.trade(), x.trade())), "i j"), "SELECT a.i, b.i AS j, a.v * b.v AS value FROM t a, t b WHERE a.i = a.j AND b.i = b.j", "t")
_query("axis_sum_i", lambda x: _out(einsum("ij->i", x.trade()), "i"), "SELECT i, SUM(v) AS value FROM t GROUP BY 1", "t")
_query("axis_sum_j", lambda x: _out(einsum("ij->j", x.trade()), "j"), "SELECT j, SUM(v) AS value FROM t GROUP BY 1", "t")
_query("axis_sum_middle", lambda x: _out(einsum("ijk->ik", _cube(x)), "i k"), "SELECT i, k, SUM(v) AS value FROM c GROUP BY 1, 2", "t")
_FOUND["axis_sum_middle"] = (_FOUND["axis_sum_middle"][0], _FOUND["axis_sum_middle"][1].replace(_CTE["t"], _CUBE))
_query("sum_all", lambda x: _out(einsum("ij->", x.trade()), ""), "SELECT SUM(v) AS value FROM t", "t")
_query("permute", lambda x: _out(einsum("ij->ji", x.trade()), "j i"), "SELECT j, i, v AS value FROM t", "t")
_query("permute_4d", lambda x: _out(einsum("ijkl->ljki", einsum("ij,kl->ijkl", x.trade(), x.trade())), "l j k i"), "SELECT a.i, a.j, b.i AS k, b.j AS l, a.v * b.v AS value FROM t a, t b", "t")
_query("identity", lambda x: _out(einsum("ij->ij", x.trade()), "i j"), "SELECT i, j, v AS value FROM t", "t")
_query("repeat_axis", lambda x: _out(einsum("i->ij", einsum("ij->i", x.trade()), sizes={"j": 4}), "i j"), "SELECT i, r AS j, SUM(v) AS value FROM t, (SELECT CAST(range AS BIGINT) AS r FROM range(4)) GROUP BY 1, 2", "t")
_query("scalar_broadcast", lambda x: _out(einsum("->ij", rd.total(x.trade()), sizes={"i": 2, "j": 3}), "i j"), "SELECT CAST(a.range AS BIGINT) AS i, CAST(b.range AS BIGINT) AS j, (SELECT SUM(v) FROM t) AS value FROM range(2) a, range(3) b", "t")
_query("duplicate_diag", lambda x: _out(einsum("i->ii", einsum("ij->i", x.trade())), "i i_2"), "SELECT i, i AS i_2, SUM(v) AS value FROM t GROUP BY 1, 2", "t")
_query("duplicate_diag_dense", lambda x: _out(Tensor(einsum("i->ii", einsum("ij->i", x.trade())).df, (NATIONS, NATIONS)).densify(), "i i_2"), "SELECT a.x AS i, b.x AS i_2, CASE WHEN a.x = b.x THEN COALESCE(w, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS value FROM n a CROSS JOIN n b LEFT JOIN (SELECT i, SUM(v) AS w FROM t GROUP BY 1) s ON s.i = a.x", "t", "n")
_query("duplicate_ijij", lambda x: _out(einsum("ij->ijij", x.trade()), "i j i_2 j_2"), "SELECT i, j, i AS i_2, j AS j_2, v AS value FROM t", "t")


def _outer3(x: Tables) -> Tensor:
    return einsum("ij,k->ijk", x.trade(), einsum("ij->j", x.trade()))


def _cube_square(x: Tables) -> Tensor:
    return einsum("i,jk->ijk", einsum("ij->j", x.trade()), x.trade())


# element by element

_query("map_scale", lambda x: _out(ew.map_cells(x.trade(), lambda v: v * 2 + 1), "i j"), "SELECT i, j, v * 2 + 1 AS value FROM t", "t")
_query("map_dense", lambda x: _out(ew.map_cells(x.trade(), lambda v: v + 1, dense=True), "i j"), "SELECT a.x AS i, b.x AS j, COALESCE(v, 0.0::DOUBLE) + 1 AS value FROM n a CROSS JOIN n b LEFT JOIN t ON t.i = a.x AND t.j = b.x", "t", "n")
_OUTER = "FROM t a FULL JOIN t b ON a.i = b.j AND a.j = b.i"
_query("zip2", lambda x: _out(ew.zip_map(lambda a, b: a - b, x.trade(), x.trade().transpose_2d()), "i j"), f"SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, COALESCE(a.v, 0.0::DOUBLE) - COALESCE(b.v, 0.0::DOUBLE) AS value {_OUTER}", "t")
_query("zip3", lambda x: _out(ew.zip_map(lambda a, b, c: a + b * c, x.trade(), x.trade().transpose_2d(), x.trade()), "i j"), f"SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, COALESCE(a.v, 0.0::DOUBLE) + COALESCE(b.v, 0.0::DOUBLE) * COALESCE(a.v, 0.0::DOUBLE) AS value {_OUTER}", "t")
_query("zip4", lambda x: _out(ew.zip_map(lambda a, b, c, d: a + b + c - d, x.trade(), x.trade().transpose_2d(), x.trade(), x.trade()), "i j"), f"SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, COALESCE(a.v, 0.0::DOUBLE) + COALESCE(b.v, 0.0::DOUBLE) AS value {_OUTER}", "t")


def _same_source(x: Tables) -> DataFrame:
    t = x.trade()
    return _out(ew.zip_map(lambda a, b: a * b, t, t), "i j")


_query("zip2_same_source", _same_source, "SELECT i, j, v * v AS value FROM t", "t")
_query("copy", lambda x: _out(ew.copy(x.trade()), "i j"), "SELECT i, j, v AS value FROM t", "t")
_query("add", lambda x: _out(ew.add(x.trade(), x.trade().transpose_2d()), "i j"), f"SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, COALESCE(a.v, 0.0::DOUBLE) + COALESCE(b.v, 0.0::DOUBLE) AS value {_OUTER}", "t")
_query("mul", lambda x: _out(ew.mul(x.trade(), x.trade().transpose_2d()), "i j"), "SELECT a.i, a.j, a.v * b.v AS value FROM t a JOIN t b ON a.i = b.j AND a.j = b.i", "t")
_query("axpy", lambda x: _out(ew.axpy(x.trade(), x.trade().transpose_2d(), 3.0), "i j"), f"SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, COALESCE(a.v, 0.0::DOUBLE) + 3 * COALESCE(b.v, 0.0::DOUBLE) AS value {_OUTER}", "t")
_query("fma", lambda x: _out(ew.fma(x.trade(), x.trade(), x.trade()), "i j"), "SELECT i, j, v + v * v AS value FROM t", "t")
_query("copy_scale", lambda x: _out(ew.copy_scale(x.trade(), 0.5), "i j"), "SELECT i, j, 0.5 * v AS value FROM t", "t")
_query("copy_conj", lambda x: _out(ew.copy_conj(x.trade_complex()), "i j"), "SELECT i, j, re AS value_re, -im AS value_im FROM z", "z")
_query("transpose_scale", lambda x: _out(ew.copy_transpose_scale(x.trade(), 0.25), "i j"), "SELECT j AS i, i AS j, 0.25 * v AS value FROM t", "t")
_query("symmetrize", lambda x: _out(ew.symmetrize(x.trade()), "i j"), f"SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, (COALESCE(a.v, 0.0::DOUBLE) + COALESCE(b.v, 0.0::DOUBLE)) * 0.5 AS value {_OUTER}", "t")
_query("symmetrize_conj", lambda x: _out(ew.symmetrize_conj(x.trade_complex()), "i j"), "SELECT COALESCE(a.i, b.j) AS i, COALESCE(a.j, b.i) AS j, (COALESCE(a.re, 0.0::DOUBLE) + COALESCE(b.re, 0.0::DOUBLE)) * 0.5 AS value_re, (COALESCE(a.im, 0.0::DOUBLE) - COALESCE(b.im, 0.0::DOUBLE)) * 0.5 AS value_im FROM z a FULL JOIN z b ON a.i = b.j AND a.j = b.i", "z")
_query("promote", lambda x: _out(x.trade().to_complex(), "i j"), "SELECT i, j, v AS value_re, 0.0::DOUBLE AS value_im FROM t", "t")
_query("demote", lambda x: _out(x.trade().to_complex().try_to_real(), "i j"), "SELECT i, j, v AS value FROM t", "t")

# reductions


def _rounded(t: Tensor, names: str, digits: int = 6) -> DataFrame:
    return _out(ew.map_cells(t, lambda v: F.round(v, digits)), names)


def _turned(re, im):
    """1, i, -1 or -i, by the real part's rest modulo 4."""
    quarter = re.cast("long") % 4
    return F.when(quarter == 0, 1.0).when(quarter == 2, -1.0).otherwise(0.0), F.when(quarter == 1, 1.0).when(quarter == 3, -1.0).otherwise(0.0)


def _unsigned(t: Tensor) -> Tensor:
    """Zeros without a sign."""
    return ew.map_cells(t, lambda re, im: (F.when(re == 0, 0.0).otherwise(re), F.when(im == 0, 0.0).otherwise(im)))


_TURN = "CASE q WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS value_re, CASE q WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS value_im"
def _exact_sql(value: str, table: str, bits: int, key: str = "") -> str:
    """The exact sum of doubles that are whole numbers of ``2 ** -bits``, rounded once: 61 bits
    go into a double, the lowest of which says whether any lower one is set."""
    by = f"{key} AS s, " if key else ""
    sums = f"SELECT {by}SUM(CAST({value} * {2.0**bits:.0f} AS HUGEINT)) AS h FROM {table}{' GROUP BY 1' if key else ''}"
    cut = "CAST(greatest(0, floor(log2(CAST(h AS DOUBLE))) - 60) AS INTEGER)"
    power = f"SELECT *, {cut} AS b, CAST(pow(2.0::DOUBLE, {cut}) AS HUGEINT) AS p FROM ({sums})"
    return f"SELECT {'s, ' if key else ''}CAST(CAST(h // p AS BIGINT) | CASE WHEN h % p <> 0 THEN 1::BIGINT ELSE 0::BIGINT END AS DOUBLE) * pow(2.0::DOUBLE, b - {bits}) AS value FROM ({power})"


_query("reduce_sum", lambda x: _out(rd.reduce(x.trade()), ""), "SELECT SUM(v) AS value FROM t", "t")
_query("reduce_product", lambda x: _out(rd.reduce(x.nation_region(), PRODUCT, lambda v: v + 1), ""), "SELECT CAST(POW(2, COUNT(*)) AS DOUBLE) AS value FROM nation")
_query("reduce_sumsq", lambda x: _out(rd.reduce(x.trade(), f=lambda v: v * v), ""), "SELECT SUM(v * v) AS value FROM t", "t")
_query("reduce_max", lambda x: _out(rd.reduce(x.trade(), MAX), ""), "SELECT MAX(v) AS value FROM t", "t")
_query("reduce_min_dense", lambda x: _out(rd.reduce(x.trade().densify(), MIN), ""), "SELECT MIN(COALESCE(v, 0.0::DOUBLE)) AS value FROM n a CROSS JOIN n b LEFT JOIN t ON t.i = a.x AND t.j = b.x", "t", "n")
_query("reduce_count", lambda x: _out(rd.reduce(x.trade(), COUNT), ""), "SELECT COUNT(*) AS value FROM t", "t")
_query("reduce_axis_sum", lambda x: _out(rd.reduce_axis(x.trade(), 1), "i"), "SELECT i, SUM(v) AS value FROM t GROUP BY 1", "t")
_query("reduce_axis_max", lambda x: _out(rd.reduce_axis(x.trade(), 0, MAX), "j"), "SELECT j, MAX(v) AS value FROM t GROUP BY 1", "t")
_query("reduce_axis_mapped", lambda x: _out(rd.reduce_axis(x.trade(), 0, f=lambda v: v * v), "j"), "SELECT j, SUM(v * v) AS value FROM t GROUP BY 1", "t")
_query("reduce_trace_axes", lambda x: _out(rd.reduce_axes(_cube(x), rd.trace_axes("ijk", "j", "j")), "j"), "SELECT j, SUM(v) AS value FROM t GROUP BY 1", "t")
_query("dot", lambda x: _out(rd.dot(x.trade(), x.trade().transpose_2d()), ""), "SELECT COALESCE(SUM(a.v * b.v), 0.0::DOUBLE) AS value FROM t a JOIN t b ON a.i = b.j AND a.j = b.i", "t")

_query("reduce_logsumexp", lambda x: _rounded(rd.reduce_axis(ew.map_cells(x.trade(), lambda v: v / 1000), 1, LOGSUMEXP), "i"), "SELECT i, ROUND(LN(SUM(EXP(v / 1000))), 6) AS value FROM t GROUP BY 1", "t")
_query("reduce_argmax", lambda x: _out(rd.reduce_axis(x.trade(), 1, extreme_place(1)), "i"), "SELECT i, j AS value FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS n FROM t) WHERE n = 1", "t")
_query("reduce_argmin_sales", lambda x: _out(rd.reduce_axis(x.sales("l_suppkey"), 1, extreme_place(1, largest=False)), "s"), "SELECT s, p AS value FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v, p) AS n FROM sp) WHERE n = 1", "sp")
_query("reduce_complex_product", lambda x: _out(_unsigned(rd.reduce_axis(x.trade_complex(), 1, PRODUCT, _turned)), "i"), f"SELECT i, {_TURN} FROM (SELECT i, SUM(CAST(re AS BIGINT)) % 4 AS q FROM z GROUP BY 1)", "z")
_query("reduce_complex_product_all", lambda x: _out(_unsigned(rd.reduce(x.trade_complex(), PRODUCT, _turned)), ""), f"SELECT {_TURN} FROM (SELECT SUM(CAST(re AS BIGINT)) % 4 AS q FROM z)", "z")
_query("reduce_complex_sumsq", lambda x: _out(rd.reduce(x.trade_complex(), f=lambda re, im: (re * re - im * im, re * im * 2)), ""), "SELECT SUM(re * re - im * im) AS value_re, SUM(re * im * 2) AS value_im FROM z", "z")
_query("reduce_complex_norm", lambda x: _out(rd.reduce_axis(x.trade_complex(), 0, f=lambda re, im: re * re + im * im), "j"), "SELECT j, SUM(re * re + im * im) AS value FROM z GROUP BY 1", "z")
_query("exact_sum_by_supplier", lambda x: _out(src.from_table(x.table("lineitem"), ["l_suppkey"], "l_extendedprice", exact=True), "s"), _exact_sql("l_extendedprice", "lineitem", 52, "l_suppkey"))
_query("exact_sum_all", lambda x: _out(rd.reduce(src.from_table(x.table("lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_extendedprice") * F.col("l_discount"), unique=True), EXACT_SUM), ""), _exact_sql("(l_extendedprice * l_discount)", "lineitem", 52))
_query("exact_dot", lambda x: _out(rd.dot(x.prices(), x.prices(), exact=True), ""), _exact_sql("(o_totalprice * o_totalprice)", "orders", 36))

# complex values and semirings

_PRODUCT = "SELECT a.i, b.j AS k, SUM(a.re * b.re - a.im * b.im) AS value_re, SUM(a.re * b.im + a.im * b.re) AS value_im FROM z a JOIN z b ON a.j = b.i GROUP BY 1, 2"
_query("complex_matmul", lambda x: _out(einsum("ij,jk->ik", x.trade_complex(), x.trade_complex()), "i k"), _PRODUCT, "z")
_query("complex_conj_matmul", lambda x: _out(einsum2(x.trade_complex(), x.trade_complex(), "ij", "jk", "ik", conj_a=True), "i k"), _PRODUCT.replace("a.im", "(-a.im)"), "z")
_query("complex_conj_hadamard", lambda x: _out(einsum("ij,ij->ij", x.trade_complex().conj(), x.trade_complex()), "i j"), "SELECT i, j, re * re + im * im AS value_re, re * im - im * re AS value_im FROM z", "z")
_query("adjoint", lambda x: _out(x.trade_complex().adjoint_2d(), "i j"), "SELECT j AS i, i AS j, re AS value_re, -im AS value_im FROM z", "z")
_query("mixed_matmul", lambda x: _out(einsum("ij,jk->ik", x.trade(), x.trade_complex()), "i k"), "SELECT a.i, b.j AS k, SUM(a.v * b.re) AS value_re, SUM(a.v * b.im) AS value_im FROM t a JOIN z b ON a.j = b.i GROUP BY 1, 2", "t", "z")
_query("einsum2_mapped_complex", lambda x: _out(einsum2(x.trade_complex(), x.trade_complex(), "ij", "jk", "ik", map_a=lambda re, im: (re + 1, im - 2), map_b=lambda re, im: (im, -re)), "i k"), """SELECT a.x AS i, b.j AS k, SUM((COALESCE(z.re, 0.0::DOUBLE) + 1) * b.im - (COALESCE(z.im, 0.0::DOUBLE) - 2) * -b.re) AS value_re, SUM((COALESCE(z.re, 0.0::DOUBLE) + 1) * -b.re + (COALESCE(z.im, 0.0::DOUBLE) - 2) * b.im) AS value_im
    FROM n a CROSS JOIN n m LEFT JOIN z ON z.i = a.x AND z.j = m.x JOIN z b ON b.i = m.x GROUP BY 1, 2""", "z", "n")
_query("complex_trace", lambda x: _out(einsum("ii->", x.trade_complex()), ""), "SELECT SUM(re) AS value_re, SUM(im) AS value_im FROM z WHERE i = j", "z")
_query("maxplus_matmul", lambda x: _out(einsum("ij,jk->ik", x.trade(), x.trade(), semiring=MAX_PLUS), "i k"), "SELECT a.i, b.j AS k, MAX(a.v + b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("minplus_matmul", lambda x: _out(einsum("ij,jk->ik", x.trade(), x.trade(), semiring=MIN_PLUS), "i k"), "SELECT a.i, b.j AS k, MIN(a.v + b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("maxtimes_matmul", lambda x: _out(einsum("ij,jk->ik", x.trade(), x.trade(), semiring=MAX_TIMES), "i k"), "SELECT a.i, b.j AS k, MAX(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("bool_reach", lambda x: _out(_reach(x), "i k"), "SELECT a.i, b.j AS k, BOOL_OR(a.v > 5000 AND b.v > 5000) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")


def _reach(x: Tables) -> Tensor:
    edge = ew.map_cells(x.trade(), lambda v: v > 5000)
    return einsum("ij,jk->ik", edge, edge, semiring=BOOL_OR_AND)


# symbols, updates and stored forms


def _updates(x: Tables) -> DataFrame:
    """Order lines as updates of the trade's cells: price by nation and part of the supplier key, the last ship date winning."""
    lines = x.table("lineitem").select((F.col("l_orderkey") % NATIONS).alias("a0"), (F.col("l_suppkey") % NATIONS).alias("a1"), F.col("l_quantity").alias("v"), "l_shipdate")
    return lines.select("a0", "a1", F.when(F.col("a0") != F.col("a1"), F.col("v")).alias("v"), F.struct("l_shipdate", "v").alias("version"))


def _log(x: Tables) -> DataFrame:
    """The same in two batches, the first of which is compacted away."""
    log = UpdateLog(x.trade(), f"{scratch_dir(x.spark)}/log-{uuid.uuid4().hex}")
    new = _updates(x)
    log.append(new.where("a0 < 12"))
    log.compact()
    log.append(new.where("a0 >= 12"))
    return _out(log.read(), "i j")


def _copartitioned(x: Tables) -> DataFrame:
    name = f"tensor_{uuid.uuid4().hex}"
    stored = [write_bucketed(t, f"{name}_{k}", [k], 8, f"{scratch_dir(x.spark)}/{name}_{k}") for t, k in ((x.sales("l_suppkey"), 1), (x.part_brand(), 0))]
    return _out(einsum("sp,pb->sb", *stored), "s b")


def _log_sql() -> str:
    new = "u AS (SELECT i, j, arg_max(CASE WHEN i <> j THEN v END, ROW(l_shipdate, v)) AS v, arg_max(i = j, ROW(l_shipdate, v)) AS gone FROM (SELECT l_orderkey % 25 AS i, l_suppkey % 25 AS j, l_quantity AS v, l_shipdate FROM lineitem) GROUP BY 1, 2)"
    return f"WITH {_CTE['t']}, {new} SELECT COALESCE(u.i, t.i) AS i, COALESCE(u.j, t.j) AS j, CASE WHEN u.i IS NULL THEN t.v ELSE u.v END AS value FROM t FULL JOIN u ON t.i = u.i AND t.j = u.j WHERE u.i IS NULL OR NOT u.gone"


_query("repeat_then_matmul", lambda x: _out(einsum("ij,jk->ik", einsum("i->ij", einsum("ij->i", x.trade()), sizes={"j": NATIONS}), x.trade()), "i k"), "SELECT a.i, b.j AS k, SUM(a.v * b.v) AS value FROM (SELECT i, SUM(v) AS v FROM t GROUP BY 1) a, t b GROUP BY 1, 2", "t")
_query("repeat_then_sum", lambda x: _out(einsum("ijk->i", einsum("ij->ijk", x.trade(), sizes={"k": 7})), "i"), "SELECT i, 7 * SUM(v) AS value FROM t GROUP BY 1", "t")
_query("delta_matmul", lambda x: _out(einsum("ij,jk,kl->il", x.trade(), identity(x.spark, NATIONS), x.trade()), "i l"), "SELECT a.i, b.j AS l, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("constant_weights", lambda x: _out(einsum("sp,pb,b->s", x.sales("l_suppkey"), x.part_brand(), constant(x.spark, (30,), 2.0)), "s"), "SELECT s, SUM(2 * v) AS value FROM sp JOIN pb USING (p) WHERE b < 30 GROUP BY 1", "sp", "pb")
_query("set_many", lambda x: _out(set_many(x.trade(), _updates(x)), "i j"), None)
_query("update_log", _log, None)
for _name in ("set_many", "update_log"):
    _FOUND[_name] = (_FOUND[_name][0], _log_sql())
_query("copartitioned_matmul", _copartitioned, "SELECT s, b, SUM(v) AS value FROM sp JOIN pb USING (p) GROUP BY 1, 2", "sp", "pb")
_query("measured_matmul", lambda x: _out(einsum("sp,pc->sc", x.sales("l_suppkey").measured(), x.customer_part().permute((1, 0)).measured()), "s c"), "SELECT s, c, SUM(sp.v * cp.v) AS value FROM sp JOIN cp USING (p) GROUP BY 1, 2", "sp", "cp")

# views, cells and sources

_query("get_element", lambda x: _out(x.trade().get((3, 4)), ""), "SELECT COALESCE(SUM(v), 0.0::DOUBLE) AS value FROM t WHERE i = 3 AND j = 4", "t")
_query("set_element", lambda x: _out(x.trade().set((3, 4), -1.0), "i j"), "SELECT i, j, v AS value FROM t WHERE NOT (i = 3 AND j = 4) UNION ALL SELECT 3, 4, -1.0::DOUBLE", "t")
_query("broadcast_axis", lambda x: _out(einsum("i->iz", einsum("ij->i", x.trade()), sizes={"z": 1}).broadcast((NATIONS, 3)), "i j"), "SELECT i, r AS j, SUM(v) AS value FROM t, (SELECT CAST(range AS BIGINT) AS r FROM range(3)) GROUP BY 1, 2", "t")
_query("diagonal_view", lambda x: _out(x.trade().diagonal([(0, 1)]), "i"), "SELECT i, v AS value FROM t WHERE i = j", "t")
_query("permute_view", lambda x: _out(_cube(x).permute((2, 0, 1)), "k i j"), "SELECT i, j, k, v AS value FROM c", "t")
_FOUND["permute_view"] = (_FOUND["permute_view"][0], _FOUND["permute_view"][1].replace(_CTE["t"], _CUBE))
_query("densify", lambda x: _out(x.trade().densify(), "i j"), "SELECT a.x AS i, b.x AS j, COALESCE(v, 0.0::DOUBLE) AS value FROM n a CROSS JOIN n b LEFT JOIN t ON t.i = a.x AND t.j = b.x", "t", "n")
_query("table_to_tensor", lambda x: _out(x.sales("l_suppkey"), "s p"), "SELECT s, p, v AS value FROM sp", "sp")
_query("array_column_to_tensor", lambda x: _out(x.embeddings(), "i k"), "SELECT i, k, v AS value FROM e", "e")
_query("events_user_type_cooccurrence", lambda x: _out(einsum("ut,uv->tv", x.events(), x.events()), "t v"), "SELECT a.t, b.t AS v, SUM(a.n * b.n) AS value FROM h a JOIN h b USING (u) GROUP BY 1, 2", "h")

# files, views of them, arrays in memory, grids, empty axes, plans and errors

_DENSE = "COALESCE(t.v, 0.0::DOUBLE)"
_EVERY = "FROM n a CROSS JOIN n b LEFT JOIN t ON t.i = a.x AND t.j = b.x"


def _stored(x: Tables) -> tuple[str, int]:
    """The embeddings as an array of chunks, which the executors write, and its number of rows."""
    t, path = x.embeddings(), f"{scratch_dir(x.spark)}/embeddings-{uuid.uuid4().hex}"
    last = x.table("embeddings").agg(F.max("vec_id")).first()[0]
    n = 0 if last is None else last + 1
    write_chunks(Tensor(t.df, (n, 64)), path)
    return path, n


def _view(dims, strides=None, offset=lambda n: 0, *, checked: bool = True) -> Callable[[Tables], Tensor]:
    """A view of the stored embeddings, by functions of the number of rows."""

    def read(x: Tables) -> Tensor:
        path, n = _stored(x)
        return from_file(x.spark, path, dims(n), strides, offset(n), checked=checked)

    return read


def _trade_array(x: Tables) -> np.ndarray:
    return src.to_numpy(x.trade())


def _rejected(x: Tables) -> DataFrame:
    """What is wrong with each of some contractions of a table's tensor, by the name of the error, and the cells of that tensor."""
    t, tall = x.trade(), src.zeros(x.spark, (4, 2))
    cases = {
        "inner sizes differ": lambda: einsum("ij,jk->ik", t, tall),
        "label of no operand": lambda: einsum2(t, t, "ij", "ki", "kz"),
        "label twice in the output": lambda: einsum2(t, t, "ij", "ki", "kk"),
        "no arrow": lambda: einsum("ij,jk", t, t),
        "one operand too few": lambda: einsum("ij,jk->ik", t),
        "more labels than axes": lambda: einsum("ijk->i", t),
        "maximum of complex values": lambda: rd.reduce(x.trade_complex(), MAX),
        "complex semiring": lambda: einsum("ij,jk->ik", t, x.trade_complex(), semiring=MAX_PLUS),
        "view beyond its buffer": lambda: src.from_buffer(x.spark, [1.0, 2.0], (2, 2), (2, 1)),
        "strides and sizes": lambda: src.from_buffer(x.spark, [1.0, 2.0], (2,), (2, 1)),
    }
    found = []
    for name, call in cases.items():
        try:
            call()
            found.append((name, "none"))
        except TensorError as e:
            found.append((name, type(e).__name__))
    return x.spark.createDataFrame(found, "case string, error string").crossJoin(t.df.agg(F.count(F.lit(1)).alias("cells")))


def _plan(x: Tables) -> DataFrame:
    """Roles of the labels of a product of order lines, and how many coordinates each has in the table."""
    lines = x.table("lineitem").select(F.floor((F.col("l_quantity") - 1) / 10).alias("b"), F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_linenumber").alias("p"), F.col("l_suppkey").alias("k"), F.col("l_discount").alias("q"))
    plan = plan_pair("bijp", "bjkq", "bik")
    roles = [F.struct(F.lit(label).alias("label"), F.lit(role).alias("role"), F.col(label).alias("size")) for role in ("batch", "left", "right", "summed", "left_trace", "right_trace") for label in getattr(plan, role)]
    return lines.agg(*[F.count_distinct(c).alias(c) for c in lines.columns]).select(F.inline(F.array(*roles)))


def _shape(x: Tables) -> DataFrame:
    t = einsum("ij,k->kji", x.trade_complex(), src.zeros(x.spark, (3,))).conj()
    rows = [("rank", t.rank), ("cells", len(t)), ("complex", int(t.is_complex())), ("empty", int(t.is_empty)), *[(a, n) for a, n in zip(t.axes, t.dims, strict=True)]]
    return x.spark.createDataFrame(rows, "what string, n long").unionByName(t.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("stored").alias("what"), "n"))


def _whole_trade(x: Tables) -> Tensor:
    """Trade as whole numbers."""
    return ew.map_cells(x.trade(), lambda v: v.cast("long"))


_query("npy_round_trip", lambda x: _out(from_file(x.spark, _stored(x)[0]), "i k"), "SELECT i, k, v AS value FROM e", "e")
_query("strided_buffer_view", lambda x: _out(_view(lambda n: (n, 16), (-64, 4), lambda n: (n - 1) * 64)(x), "i j"), "SELECT (SELECT MAX(i) FROM e) - i AS i, k // 4 AS j, v AS value FROM e WHERE k % 4 = 0", "e")
_query("row_major_buffer", lambda x: _out(_view(lambda n: (n, 8, 8))(x), "i j k"), "SELECT i, k // 8 AS j, k % 8 AS k, v AS value FROM e", "e")
_query("buffer_unchecked_view", lambda x: _out(_view(lambda n: (4, n), (0, 64), lambda n: 5, checked=False)(x), "i j"), "SELECT CAST(range AS BIGINT) AS i, i AS j, v AS value FROM e, range(4) WHERE k = 5", "e")
_query("from_fn_grid", lambda x: _out(ew.zip_map(lambda a, b: a + b, src.from_fn(x.spark, (NATIONS, NATIONS), lambda i, j: (i * 10 + j).cast("double")), x.trade()), "i j"), f"SELECT a.x AS i, b.x AS j, a.x * 10 + b.x + {_DENSE} AS value {_EVERY}", "t", "n")
_query("zeros_grid", lambda x: _out(ew.add(src.zeros(x.spark, (NATIONS, NATIONS)), x.trade()), "i j"), f"SELECT a.x AS i, b.x AS j, {_DENSE} AS value {_EVERY}", "t", "n")
_query("identity_matrix", lambda x: _out(ew.add(einsum("->ii", src.from_fn(x.spark, (), lambda: F.lit(1.0)), sizes={"i": NATIONS}).densify(), x.trade()), "i i_2"), f"SELECT a.x AS i, b.x AS i_2, {_DENSE} + CASE WHEN a.x = b.x THEN 1 ELSE 0 END AS value {_EVERY}", "t", "n")
_query("numpy_to_tensor", lambda x: _out(src.from_numpy(x.spark, np.asfortranarray(_trade_array(x))[::-1]), "i j"), f"SELECT 24 - a.x AS i, b.x AS j, {_DENSE} AS value {_EVERY}", "t", "n")
_query("buffer_round_trip", lambda x: _out(src.from_parts(x.spark, src.to_buffer(x.trade(), "row"), (NATIONS, NATIONS), order="row"), "i j"), f"SELECT a.x AS i, b.x AS j, {_DENSE} AS value {_EVERY}", "t", "n")
_query("numpy_einsum", lambda x: _out(src.from_numpy(x.spark, einsum_numpy(x.spark, "ij,kj->ik", _trade_array(x), _trade_array(x))), "i j"), "SELECT a.x AS i, b.x AS j, COALESCE(SUM(t.v * u.v), 0.0::DOUBLE) AS value FROM n a CROSS JOIN n b LEFT JOIN t ON t.i = a.x LEFT JOIN t u ON u.i = b.x AND u.j = t.j GROUP BY 1, 2", "t", "n")
_query("numpy_einsum_into", lambda x: _out(src.from_numpy(x.spark, einsum_numpy_into(x.spark, "ij->ji", _trade_array(x), out=_trade_array(x), alpha=2.0, beta=-1.0)), "i j"), f"SELECT a.x AS i, b.x AS j, 2 * COALESCE(u.v, 0.0::DOUBLE) - {_DENSE} AS value {_EVERY} LEFT JOIN t u ON u.i = b.x AND u.j = a.x", "t", "n")
_query("reversed_notation_matmul", lambda x: _out(einsum(reverse_notation("ij,jk->ik"), x.trade().transpose_2d(), x.trade().transpose_2d()), "k i"), "SELECT a.i, b.j AS k, SUM(a.v * b.v) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("empty_axis_contraction", lambda x: _out(einsum_into("ij,jk->ik", src.zeros(x.spark, (NATIONS, 0)), src.zeros(x.spark, (0, NATIONS)), out=x.trade(), alpha=2.0, beta=1.0), "i j"), "SELECT i, j, v AS value FROM t", "t")
_query("mixed_types_chain", lambda x: _out(einsum("ij,jk,kl->il", _whole_trade(x), x.trade(), x.trade_complex()), "i l"), "SELECT a.i, c.j AS l, SUM(a.v * b.v * c.re) AS value_re, SUM(a.v * b.v * c.im) AS value_im FROM t a JOIN t b ON a.j = b.i JOIN z c ON b.j = c.i GROUP BY 1, 2", "t", "z")
_query("whole_matmul", lambda x: _out(einsum("ij,jk->ik", _whole_trade(x), _whole_trade(x)), "i k"), "SELECT a.i, b.j AS k, CAST(SUM(a.v * b.v) AS BIGINT) AS value FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2", "t")
_query("rejected_contractions", _rejected, """SELECT v.*, (SELECT COUNT(*) FROM t) AS cells FROM (VALUES ('inner sizes differ', 'DimensionMismatch'), ('label of no operand', 'OrphanOutputAxis'), ('label twice in the output', 'DuplicateAxis'), ('no arrow', 'ParseError'),
    ('one operand too few', 'OperandCountMismatch'), ('more labels than axes', 'RankMismatch'), ('maximum of complex values', 'TypeMismatch'), ('complex semiring', 'TypeMismatch'), ('view beyond its buffer', 'OffsetOverflow'), ('strides and sizes', 'StrideLengthMismatch')) v("case", error)""", "t")
_query("contraction_plan", _plan, "SELECT label, role, size FROM (SELECT COUNT(DISTINCT floor((l_quantity - 1) / 10)) AS b, COUNT(DISTINCT l_orderkey) AS i, COUNT(DISTINCT l_partkey) AS j, COUNT(DISTINCT l_linenumber) AS p, COUNT(DISTINCT l_suppkey) AS k, COUNT(DISTINCT l_discount) AS q FROM lineitem), LATERAL (VALUES ('b', 'batch', b), ('i', 'left', i), ('k', 'right', k), ('j', 'summed', j), ('p', 'left_trace', p), ('q', 'right_trace', q)) v(label, role, size)")
_query("tensor_metadata", _shape, "SELECT * FROM (VALUES ('rank', 3::BIGINT), ('cells', 1875), ('complex', 1), ('empty', 0), ('a0', 3), ('a1', 25), ('a2', 25)) v(what, n) UNION ALL SELECT 'stored', 3 * COUNT(*) FROM z", "z")
