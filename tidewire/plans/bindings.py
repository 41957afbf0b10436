"""Messages built from the driver's tables with Spark SQL, so that DuckDB can compute the expected answers from the same
tables without any text. Each returns messages (message_id, message_type, body) unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"tw_{name}")


def _amount(col: str) -> str:
    """A message's amount: two decimals after a comma."""
    return f"replace(cast(cast({col} as decimal(18,2)) as string), '.', ',')"


_TYPE = "element_at(array('TRF','DIV','INT','CHG','FEE'), cast(substring(o_orderpriority, 1, 1) as int))"
_CURRENCY = "element_at(array('USD','EUR','GBP'), cast(c_custkey % 3 + 1 as int))"


def cash_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: opening, closing, currency and its lines in order."""
    _view(spark, sf_dir, "customer", "orders")
    return spark.sql(f"""
        with l as (
          select o_custkey, array_sort(collect_list(struct(o_orderkey as k,
            concat(':61:', date_format(o_orderdate, 'yyMMdd'),
              case o_orderstatus when 'F' then 'C' when 'O' then 'D' else 'RD' end,
              {_amount('o_totalprice')}, 'N', {_TYPE}, 'ORD', o_orderkey, '//B', o_orderkey, '\\n:86:ORDER ', o_orderkey) as line))) as lines,
            sum(cast(o_totalprice as decimal(18,2)) * case when o_orderstatus = 'O' then -1 else 1 end) as moved
          from tw_orders group by o_custkey)
        select c_custkey, {_CURRENCY} as currency, cast(c_acctbal as decimal(18,2)) as opening,
          cast(c_acctbal as decimal(18,2)) + coalesce(moved, 0) + case when c_custkey % 7 = 0 then 1 else 0 end as closing,
          coalesce(transform(lines, x -> x.line), array()) as lines
        from tw_customer left join l on c_custkey = o_custkey""")


def _balance(tag: str, date: str, col: str) -> str:
    return f"concat('\\n:{tag}:', if({col} < 0, 'D', 'C'), '{date}', currency, {_amount(f'abs({col})')})"


def bare_mt940(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, text: the statement without its envelope."""
    facts = cash_facts(spark, sf_dir)
    head = "concat(':20:ST', c_custkey, '\\n:25:ACC', c_custkey, '\\n:28C:1/1')"
    lines = "if(size(lines) = 0, '', concat('\\n', array_join(lines, '\\n')))"
    return facts.selectExpr("c_custkey", f"concat({head}, {_balance('60F', '250101', 'opening')}, {lines}, {_balance('62F', '250131', 'closing')}) as text")


def mt940(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bare_mt940(spark, sf_dir).selectExpr(
        "concat('mt940-', c_custkey) as message_id", "'MT940' as message_type",
        "concat('{1:F01BANKUS33AXXX0000000000}{2:I940CUSTGB2LXXXXN}{4:\\n', text, '\\n-}') as body",
    )


#: The line's keywords, by partkey: sovereign bond, fund, corporate bond, share, none.
_DESC = "concat(p_type, ' ', element_at(array('GILT 4%','ETF','5% BOND','ORD','UNITS'), cast(p_partkey % 5 + 1 as int)))"


def lines537(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part's description, the line's place i in its order and what its message says of it."""
    _view(spark, sf_dir, "lineitem", "part", "orders")
    return spark.sql(f"""
        select l_orderkey, l_suppkey, o_custkey, o_orderdate, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) - 1 as int) as i,
          concat('L', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as ref, concat('US', lpad(l_partkey, 10, '0')) as isin, {_DESC} as descr,
          case l_returnflag when 'A' then 'PEND' when 'R' then 'PENF' else 'FUTU' end as status,
          l_quantity as quantity, l_extendedprice as price, l_shipdate as shipped
        from tw_lineitem join tw_part on l_partkey = p_partkey join tw_orders on l_orderkey = o_orderkey""")


def mt537(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending statement per order, one STAT block with one transaction per line."""
    block = f"""concat_ws('\\n', ':16R:STAT', concat(':25D::IPRC//', status), ':16R:TRAN', ':16R:LINK', concat(':20C::RELA//', ref), ':16S:LINK', ':16R:TRANSDET',
        concat(':35B:ISIN ', isin, '\\n', descr), concat(':36B::SETT//UNIT/', cast(quantity as long), ','), concat(':19A::PSTA//USD', {_amount('price')}), concat(':98A::SETT//', date_format(shipped, 'yyyyMMdd')),
        ':16R:SETPRTY', concat(':95P::DEAG//BANK', lpad(l_suppkey, 4, '0')), concat(':97A::SAFE//S', l_suppkey), ':16S:SETPRTY', ':16S:TRANSDET', ':16S:TRAN', ':16S:STAT')"""
    rows = lines537(spark, sf_dir).groupBy("l_orderkey", "o_custkey", "o_orderdate").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(block).alias("b")))).alias("bs"))
    head = "concat_ws('\\n', ':16R:GENL', ':28E:1/ONLY', concat(':20C::SEME//O', l_orderkey), concat(':98A::STAT//', date_format(o_orderdate, 'yyyyMMdd')), concat(':97A::SAFE//ACC', o_custkey), ':16S:GENL')"
    return rows.selectExpr("concat('mt537-', l_orderkey) as message_id", "'MT537' as message_type", f"concat('{{1:F01CUSTUS33AXXX0000000000}}{{2:O5370000000101CSDXUS33XXXX00000000000000000000N}}{{4:\\n', {head}, '\\n', array_join(transform(bs, x -> x.b), '\\n'), '\\n-}}') as body")


def mt540(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settlement instruction per order; every 10th lacks :20C::SEME, every 15th has two :35B:, every 21st nests wrongly, every
    33rd has a sequence that no rule knows."""
    _view(spark, sf_dir, "orders")
    return spark.sql(f"""
        select concat('mt540-', o_orderkey) as message_id, 'MT540' as message_type,
          concat('{{1:F01CUSTUS33AXXX0000000000}}{{2:I540CSDXUS33XXXXN}}{{4:\\n', concat_ws('\\n', ':16R:GENL', if(o_orderkey % 10 = 0, null, concat(':20C::SEME//O', o_orderkey)), ':23G:NEWM', ':16S:GENL',
            ':16R:TRADDET', concat(':98A::SETT//', date_format(o_orderdate, 'yyyyMMdd')), concat(':35B:ISIN US', lpad(o_orderkey, 10, '0')), if(o_orderkey % 15 = 0, ':35B:ISIN US9999999999', null),
            if(o_orderkey % 21 = 0, ':16R:SETPRTY\\n:95P::DEAG//BANK0001\\n:16S:SETPRTY', null), ':16S:TRADDET',
            ':16R:FIAC', ':36B::SETT//UNIT/100,', concat(':97A::SAFE//C', o_custkey), ':16S:FIAC',
            if(o_orderkey % 33 = 0, ':16R:WRONG\\n:70E::SPRO//TEXT\\n:16S:WRONG', null),
            ':16R:SETDET', ':22F::SETR//TRAD', ':16R:SETPRTY', ':95P::DEAG//BANK0002', ':16S:SETPRTY', ':16R:AMT', concat(':19A::SETT//EUR', {_amount('o_totalprice')}), ':16S:AMT', ':16S:SETDET'), '\\n-}}') as body
        from tw_orders""")


def mt536(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of transactions per order, TRADDET and SETDET groups side by side, one of each per line."""
    rows = lines537(spark, sf_dir)
    trade = "concat_ws('\\n', ':16R:TRADDET', concat(':35B:ISIN ', isin, '\\n', descr), concat(':36B::PSTA//UNIT/', cast(quantity as long), ','), concat(':98A::SETT//', date_format(shipped, 'yyyyMMdd')), ':16S:TRADDET')"
    settle = f"concat_ws('\\n', ':16R:SETDET', ':22F::SETR//TRAD', ':16R:AMT', concat(':19A::SETT//GBP', {_amount('price')}), ':16S:AMT', ':16S:SETDET')"
    both = rows.groupBy("l_orderkey", "o_custkey").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(trade).alias("t"), F.expr(settle).alias("s")))).alias("bs"))
    return both.selectExpr(
        "concat('mt536-', l_orderkey) as message_id", "'MT536' as message_type",
        "concat('{1:F01CUSTUS33AXXX0000000000}{2:O5360000000101CSDXUS33XXXX00000000000000000000N}{4:\\n:16R:GENL\\n:20C::SEME//P', l_orderkey, '\\n:97A::SAFE//ACC', o_custkey, '\\n:16S:GENL\\n', array_join(transform(bs, x -> x.t), '\\n'), '\\n', array_join(transform(bs, x -> x.s), '\\n'), '\\n-}') as body",
    )


#: Customers whose statements are in one file, so that files don't grow with the tables.
PER_FILE = 100


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, k, body: the statements of PER_FILE customers in each batch, an acknowledgement before each."""
    messages = mt940(spark, sf_dir).withColumn("k", F.expr("cast(substring(message_id, 7) as long)"))
    one = F.concat(F.lit("{1:F21BANKUS33AXXX0000000000}{4:{177:2501010000}{451:0}}"), F.col("body"))
    return messages.select(F.floor(F.col("k") / PER_FILE).alias("batch"), "k", one.alias("body"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, name, content: a file per batch, $ and line ends between its statements."""
    return content(filed(spark, sf_dir))


def content(rows: DataFrame) -> DataFrame:
    """The files that batch, k and body make."""
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("k", F.col("body").alias("b")))).alias("bs"))
    return grouped.selectExpr("concat('broker:batch-', batch) as source_id", "concat('batch', batch, '.fin') as name", "cast(array_join(transform(bs, x -> x.b), '$\\r\\n') as binary) as content")
