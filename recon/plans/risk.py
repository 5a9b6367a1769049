"""The deep credit-risk model: eight tables, a wrong-input plant, and its invariants.

A cycle is an order and a contract a customer. Estimates are fixed arithmetic of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recon.functions.compare import EPS_FORMULA, beyond
from recon.functions.exact import MONEY, money, rate, yyyymm
from recon.functions.text import stable_order
from recon.plans.spec import Frames

# Fixed values of the model.
CCF = "0.75"
PD_FLOOR_MORTGAGE, PD_FLOOR_OTHER = "0.0005", "0.0003"
LGD_FLOOR_MORTGAGE, LGD_FLOOR_CORPORATE = "0.30", "0.45"
LGD_MARGIN, LGD_DOWNTURN, PD_DOWNTURN = "1.05", "1.15", "1.5"
SEGMENT_OF = {
    "AUTOMOBILE": "CORP", "MACHINERY": "SME", "BUILDING": "RETAIL_HIP",
    "HOUSEHOLD": "RETAIL_CONS", "FURNITURE": "RETAIL_CONS",
}
COLLATERAL_OF = {"RETAIL_HIP": "HIPOTECA", "CORP": "NINGUNA", "SME": "PRENDA", "RETAIL_CONS": "NINGUNA"}
# Rating up to, lowest and highest default probability in millionths.
PD_BANDS = ((4, 600, 20_000), (8, 10_000, 50_000), (12, 30_000, 120_000), (16, 80_000, 180_000))
# Derived field -> its direct inputs.
FIELD_DEPENDENCIES: dict[str, tuple[str, ...]] = {
    "PD_FINAL": ("PD_ESTIMADA", "PD_SUELO"),
    "PD_SUELO": ("SEGMENTO", "GARANTIA_TIPO"),
    "LGD_FINAL": ("LGD_CON_MOC", "LGD_SUELO"),
    "LGD_CON_MOC": ("LGD_ESTIMADA",),
    "LGD_SUELO": ("GARANTIA_TIPO", "SEGMENTO"),
    "EAD_TOTAL": ("EAD_BALANCE", "EAD_FUERA"),
    "EAD_BALANCE": ("OR_DISPTO",),
    "EAD_FUERA": ("CCF", "OR_DISBLE"),
    "ECL": ("PD_FINAL", "LGD_FINAL", "EAD_TOTAL"),
    "RWA": ("EAD_TOTAL", "LGD_FINAL", "K_IRB"),
    "K_IRB": ("PD_FINAL",),
    "PROVISION": ("ECL",),
    "LGD_REALIZADA": ("RECUPERACION", "COSTE", "EAD_TOTAL"),
}
TABLES: dict[str, tuple[str, ...]] = {
    "t1_contratos": ("ID_CONTRATO", "SEGMENTO", "GARANTIA_TIPO", "SECTOR", "DIMENSION"),
    "t2_basilea": ("ID_CICLO", "ID_CONTRATO", "MES", "OR_DISPTO", "OR_DISBLE", "CCF"),
    "t3_colaterales": ("ID_CONTRATO", "GARANTIA_TIPO", "VALOR_INICIAL", "HAIRCUT", "VALOR_NETO"),
    "t4_ciclos": ("ID_CICLO", "ID_CONTRATO", "MES_DEFAULT", "DPDS", "STAGE", "PD_ESTIMADA",
                  "LGD_ESTIMADA", "RECUPERACION", "COSTE", "ESTADO"),
    "t5_pd_cal": ("ID_CICLO", "PD_SUELO", "PD_FINAL", "PD_DOWNTURN"),
    "t6_lgd_cal": ("ID_CICLO", "LGD_SUELO", "LGD_CON_MOC", "LGD_FINAL", "LGD_DOWNTURN"),
    "t7_ead_cal": ("ID_CICLO", "ID_CONTRATO", "MES", "EAD_BALANCE", "EAD_FUERA", "EAD_TOTAL"),
    "t8_final": ("ID_CICLO", "ID_CONTRATO", "SEGMENTO", "EAD_TOTAL", "PD_FINAL", "LGD_FINAL", "ECL",
                 "RWA", "PROVISION", "LGD_REALIZADA", "ESTADO"),
}
PLANTED_CYCLES = 3
PLANT_SEED = 7


def _exact(text: str, kind: str = "decimal(8,4)") -> Column:
    return F.lit(text).cast(kind)


def _mapped(names: dict[str, str], column: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column)


def _scrambled(key: Column, factor: int, modulus: int) -> Column:
    """A fixed pseudo-random whole number below ``modulus``."""
    return F.pmod(F.pmod(key, F.lit(modulus)) * factor, F.lit(modulus))


def _millionths(number: Column) -> Column:
    return (number.cast("decimal(12,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")


def contracts(f: Frames) -> DataFrame:
    """One row per contract with its segment and collateral."""
    key = F.col("c_custkey")
    base = f["customer"].select(
        key.alias("ID_CONTRATO"), _mapped(SEGMENT_OF, F.col("c_mktsegment")).alias("SEGMENTO")
    ).withColumn("GARANTIA_TIPO", _mapped(COLLATERAL_OF, F.col("SEGMENTO")))
    kind, key = F.col("GARANTIA_TIPO"), F.col("ID_CONTRATO")
    value = (
        F.when(kind == "HIPOTECA", 120_000 + _scrambled(key, 1009, 380_000))
        .when(kind == "PRENDA", 10_000 + _scrambled(key, 1009, 80_000))
        .otherwise(0).cast(MONEY)
    )
    haircut = F.when(
        kind.isin("HIPOTECA", "PRENDA"),
        (200 + F.pmod(key, F.lit(600))).cast("decimal(6,0)") * _exact("0.0001", "decimal(5,4)"),
    ).otherwise(0).cast("decimal(6,4)")
    return base.withColumn("VALOR_INICIAL", value).withColumn("HAIRCUT", haircut).withColumn(
        "VALOR_NETO", F.round(F.col("VALOR_INICIAL") * (F.lit(1).cast("decimal(6,4)") - F.col("HAIRCUT")), 2).cast(MONEY)
    )


def inputs(f: Frames) -> DataFrame:
    """One row per cycle with exposures and estimates, before any calibration."""
    undrawn = (
        f["lineitem"]
        .select(F.col("l_orderkey").alias("ID_CICLO"),
                (money("l_extendedprice") * rate("l_tax")).cast("decimal(18,4)").alias("undrawn"))
        .groupBy("ID_CICLO").agg(F.sum("undrawn").alias("undrawn"))
    )
    orders = f["orders"].select(
        F.col("o_orderkey").alias("ID_CICLO"), F.col("o_custkey").alias("ID_CONTRATO"),
        yyyymm(F.col("o_orderdate")).alias("MES"), money("o_totalprice").alias("OR_DISPTO"),
    )
    kinds = contracts(f).select("ID_CONTRATO", "SEGMENTO", "GARANTIA_TIPO")
    key = F.col("ID_CICLO")
    band = F.lit(None)
    for top, low, high in reversed(PD_BANDS):
        step = F.floor((high - low) * _scrambled(key, 7919, 1000) / 1000)
        band = F.when(F.pmod(key, F.lit(16)) + 1 <= top, low + step).otherwise(band)

    def share_of_drawn(factor: int, modulus: int) -> Column:
        part = _scrambled(key, factor, modulus).cast("decimal(10,0)") * F.lit("0.001").cast("decimal(4,3)")
        return F.round(F.col("OR_DISPTO") * part, 2).cast(MONEY)

    return (
        orders.join(undrawn, "ID_CICLO", "left").join(kinds, "ID_CONTRATO", "left")
        .select(
            "ID_CICLO", "ID_CONTRATO", "MES", "SEGMENTO", "GARANTIA_TIPO", "OR_DISPTO",
            F.round(F.coalesce(F.col("undrawn"), F.lit(0).cast(MONEY)), 2).cast(MONEY).alias("OR_DISBLE"),
            _exact(CCF, "decimal(4,2)").alias("CCF"),
            _millionths(band).alias("PD_ESTIMADA"),
            _millionths(50_000 + _scrambled(key, 104_729, 870_000)).alias("LGD_ESTIMADA"),
            _scrambled(key, 37, 401).cast("int").alias("DPDS"),
            F.when(F.pmod(key, F.lit(5)) < 2, "CERRADO").otherwise("ESTIMACION").alias("ESTADO"),
            share_of_drawn(13, 551).alias("RECUPERACION"),
            share_of_drawn(17, 81).alias("COSTE"),
        )
    )


def planted_cycles(cycles: DataFrame, k: int = PLANTED_CYCLES, seed: int = PLANT_SEED) -> DataFrame:
    """The ``k`` cycles that get the wrong input, by stable order; a distributed top-k."""
    order = stable_order(F.lit(seed), F.col("ID_CICLO").cast("string"))
    return cycles.select("ID_CICLO", order.alias("_order")).orderBy("_order", "ID_CICLO").limit(k).select("ID_CICLO")


def calibrated(cycles: DataFrame, planted: DataFrame | None = None, scale: int = 1) -> DataFrame:
    """All derived columns.

    For ``planted`` cycles the off-balance exposure is taken from the drawn amount instead of the
    undrawn one, times ``scale``, and everything downstream follows.
    """
    wrong = F.lit(False)
    if planted is not None:
        marked = planted.select("ID_CICLO", F.lit(True).alias("_planted"))
        cycles = cycles.join(marked, "ID_CICLO", "left")
        wrong = F.coalesce(F.col("_planted"), F.lit(False))
    mortgage = F.col("GARANTIA_TIPO") == "HIPOTECA"
    one = F.lit(1).cast("decimal(18,8)")
    pd_floor = F.when(mortgage, _exact(PD_FLOOR_MORTGAGE)).otherwise(_exact(PD_FLOOR_OTHER)).cast("decimal(18,6)")
    lgd_floor = (
        F.when(mortgage, _exact(LGD_FLOOR_MORTGAGE))
        .when(F.col("SEGMENTO") == "CORP", _exact(LGD_FLOOR_CORPORATE))
        .otherwise(_exact("0")).cast("decimal(18,8)")
    )
    off_balance = F.when(wrong, F.col("CCF") * F.col("OR_DISPTO") * F.lit(scale).cast("decimal(6,0)")).otherwise(
        F.col("CCF") * F.col("OR_DISBLE")
    ).cast("decimal(28,4)")
    pd_final, lgd_final = F.col("PD_FINAL").cast("double"), F.col("LGD_FINAL").cast("double")
    ead = F.col("EAD_TOTAL").cast("double")
    recovered = (F.col("RECUPERACION") - F.col("COSTE")).cast("double")
    realised = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce(recovered / F.nullif(ead, F.lit(0.0)), F.lit(1.0)))), 6)
    layers = (
        {"_wrong": wrong, "PD_SUELO": pd_floor, "LGD_SUELO": lgd_floor,
         "LGD_CON_MOC": (F.col("LGD_ESTIMADA") * _exact(LGD_MARGIN)).cast("decimal(18,8)"),
         "EAD_BALANCE": F.col("OR_DISPTO"), "EAD_FUERA": off_balance,
         "STAGE": F.when(F.col("DPDS") < 30, 1).when(F.col("DPDS") < 90, 2).otherwise(3)},
        {"PD_FINAL": F.greatest("PD_ESTIMADA", "PD_SUELO"),
         "PD_DOWNTURN": F.least(one, (F.col("PD_ESTIMADA") * _exact(PD_DOWNTURN)).cast("decimal(18,8)")),
         "LGD_FINAL": F.greatest("LGD_CON_MOC", "LGD_SUELO"),
         "LGD_DOWNTURN": F.least(one, (F.col("LGD_ESTIMADA") * _exact(LGD_DOWNTURN)).cast("decimal(18,8)")),
         "EAD_TOTAL": (F.col("EAD_BALANCE") + F.col("EAD_FUERA")).cast("decimal(28,4)")},
        {"K_IRB": F.sqrt(pd_final) * 0.06 + pd_final * 0.5, "ECL": pd_final * lgd_final * ead,
         "LGD_REALIZADA": F.when(F.col("ESTADO") == "CERRADO", realised).otherwise(0.0)},
        {"RWA": ead * lgd_final * 12.5 * F.col("K_IRB"), "PROVISION": F.col("ECL")},
    )
    for layer in layers:
        cycles = cycles.withColumns(layer)
    return cycles.drop("_planted").withColumnRenamed("_wrong", "is_planted")


def risk_tables(wide: DataFrame, all_contracts: DataFrame) -> dict[str, DataFrame]:
    """The eight normalised tables, each a projection of the wide one."""
    used = all_contracts.join(wide.select("ID_CONTRATO").distinct(), "ID_CONTRATO", "left_semi")
    out = {
        "t1_contratos": used.withColumns({"SECTOR": F.lit("S1"), "DIMENSION": F.lit("MD")}),
        "t3_colaterales": used,
    }
    source = wide.withColumn("MES_DEFAULT", F.col("MES"))
    return {name: out.get(name, source).select(*columns) for name, columns in TABLES.items()}


def leaf_invariant(t8: DataFrame, eps: float = EPS_FORMULA) -> DataFrame:
    """ECL = PD * LGD * EAD inside the final table."""
    product = F.col("PD_FINAL").cast("double") * F.col("LGD_FINAL").cast("double") * F.col("EAD_TOTAL").cast("double")
    return t8.filter(beyond(F.col("ECL"), product, eps)).select("ID_CICLO")


def cross_table_invariant(t7: DataFrame, t2: DataFrame, eps: float = EPS_FORMULA) -> DataFrame:
    """EAD_FUERA = CCF * OR_DISBLE across the exposure and the source table."""
    joined = t7.join(t2.select("ID_CICLO", "ID_CONTRATO", "MES", "CCF", "OR_DISBLE"), ["ID_CICLO", "ID_CONTRATO", "MES"])
    expected = F.col("CCF") * F.col("OR_DISBLE")
    return joined.filter(beyond(F.col("EAD_FUERA"), expected, eps)).select("ID_CICLO")


def key_extraction(t7: DataFrame, t2: DataFrame, suspects: DataFrame) -> DataFrame:
    """Reported exposures of the suspect cycles beside their inputs and the expected value."""
    key = ["ID_CICLO", "ID_CONTRATO", "MES"]
    few = suspects.select("ID_CICLO")
    mine = t7.join(few, "ID_CICLO", "left_semi")
    theirs = t2.join(few, "ID_CICLO", "left_semi")
    return mine.join(theirs, key).withColumn(
        "EXPECTED_FUERA", F.round(F.col("CCF") * F.col("OR_DISBLE"), 2)
    )


def run_checks(checks: dict[str, tuple[Callable[[], DataFrame], Callable[[], DataFrame]]]) -> tuple[list[DataFrame], dict[str, str]]:
    """Flagged rows (check_name, side, ID_CICLO) of the checks that can run, and the errors of those that cannot.

    ``checks``: name to what builds the check on the trap and on the clean side. One that the analyser refuses on
    either side is invalid, and neither of its sides is kept.
    """
    flagged, errors = [], {}
    for name, sides in checks.items():
        try:
            found = [build().select("ID_CICLO") for build in sides]
        except AnalysisException as error:
            errors[name] = error.getCondition() or type(error).__name__
            continue
        flagged += [f.withColumns({"check_name": F.lit(name), "side": F.lit(side)}) for f, side in zip(found, ("trap", "clean"))]
    return flagged, errors


def invariant_verdict(flagged: DataFrame, suspects: DataFrame) -> DataFrame:
    """Per check: caught, false positive and row counts, from (check_name, side, ID_CICLO)."""
    known = suspects.select("ID_CICLO", F.lit(True).alias("_known"))
    trap, clean = F.col("side") == "trap", F.col("side") == "clean"
    return (
        flagged.join(known, "ID_CICLO", "left").groupBy("check_name").agg(
            F.count_if(trap).alias("trap_rows"), F.count_if(clean).alias("clean_rows"),
            F.coalesce(F.max(trap & F.col("_known")), F.lit(False)).alias("caught"),
        )
        .withColumn("false_positive", F.col("clean_rows") > 0)
    )
