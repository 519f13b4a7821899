"""Row rules as data: flags, verdict, reasons and class all follow from one list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger import names as n
from tripledger.functions.columns import as_flag, moment, whole_seconds


@dataclass(frozen=True)
class Limits:
    """What counts as a sound trip, seen from one fixed moment."""

    as_of: str
    max_age_days: int = n.MAX_AGE_DAYS
    vendors: tuple[int, int] = n.VENDOR_RANGE
    passengers_max: int = n.PASSENGERS_MAX
    amount_max: float = n.AMOUNT_MAX
    min_seconds: int = n.MIN_SECONDS
    max_seconds: int = n.MAX_SECONDS

    @classmethod
    def starting_now(cls, **changes) -> Limits:
        """Limits as of this moment, fixed here so that every later step sees the same one."""
        return cls(datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"), **changes)

    @property
    def now(self) -> Column:
        return moment(self.as_of)

    @property
    def today(self) -> Column:
        return F.to_date(self.now)

    @property
    def oldest(self) -> Column:
        return F.date_sub(self.today, self.max_age_days).cast("timestamp")


# The type each core column is checked against.
CORE_TYPES = {
    n.VENDOR: "int",
    n.PICKUP: "timestamp",
    n.DROPOFF: "timestamp",
    n.PASSENGERS: "int",
    n.AMOUNT: "double",
}


@dataclass(frozen=True)
class Trip:
    """Core columns of a row after a tolerant cast, and what was lost in it."""

    limits: Limits
    columns: tuple[str, ...] = ()

    def value(self, column: str) -> Column:
        return F.col(column).try_cast(CORE_TYPES[column])

    def uncastable(self, column: str) -> Column:
        """A value was there but does not fit its type.

        Once a projection has cast the values it records the outcome in the type
        flag, which then counts; otherwise the cast is tried here.
        """
        recorded = TYPE_FLAGS[column]
        if recorded in self.columns:
            return F.col(recorded) == 1
        return F.col(column).isNotNull() & self.value(column).isNull()

    def absent(self, column: str) -> Column:
        """No value was there at all."""
        recorded = TYPE_FLAGS[column]
        if recorded in self.columns:
            return F.col(column).isNull() & (F.col(recorded) == 0)
        return F.col(column).isNull()

    @property
    def seconds(self) -> Column:
        return whole_seconds(self.value(n.PICKUP), self.value(n.DROPOFF))


Check = Callable[[Trip], Column]


@dataclass(frozen=True)
class Rule:
    flag: str
    label: str
    metric: str
    report: str
    report_name: str
    fails: Check = field(repr=False, compare=False)
    error_class: str = n.CLASS_RANGE


def _uncastable(column: str) -> Check:
    return lambda t: t.uncastable(column)


def _absent(column: str) -> Check:
    return lambda t: t.absent(column)


def _never(_: Trip) -> Column:
    return F.lit(False)


def _ends_before_start(t: Trip) -> Column:
    return t.value(n.DROPOFF) <= t.value(n.PICKUP)


def _too_long(t: Trip) -> Column:
    return t.seconds > t.limits.max_seconds


def _too_short(t: Trip) -> Column:
    return t.seconds < t.limits.min_seconds


def _in_future(t: Trip) -> Column:
    return t.value(n.PICKUP) > t.limits.now


def _too_old(t: Trip) -> Column:
    return t.value(n.PICKUP) < t.limits.oldest


def _negative(column: str) -> Check:
    return lambda t: t.value(column) < 0


def _vendor_outside(t: Trip) -> Column:
    return ~t.value(n.VENDOR).between(*t.limits.vendors)


def _passengers_outside(t: Trip) -> Column:
    count = t.value(n.PASSENGERS)
    return (count < 0) | (count > t.limits.passengers_max)


def _amount_outside(t: Trip) -> Column:
    amount = t.value(n.AMOUNT)
    return (amount <= 0) | (amount > t.limits.amount_max)


# --- fixed values: flag, reason label, metric, report section, name in the report ---
TYPE, NULL, RANGE, LOGIC = "types", "nulls", "ranges", "logic"
TYPE_FLAGS = {
    n.VENDOR: "falha_tipo_vendor_id",
    n.PICKUP: "falha_tipo_pickup_datetime",
    n.DROPOFF: "falha_tipo_dropoff_datetime",
    n.PASSENGERS: "falha_tipo_passenger_count",
    n.AMOUNT: "falha_tipo_total_amount",
}
CODED = [
    Rule("falha_tipo_vendor_id", "TIPO_VENDOR_ID_INVALIDO", "qtd_erro_tipo_vendor_id",
         TYPE, "vendor_id_tipo_invalido", _uncastable(n.VENDOR), n.CLASS_TYPE),
    Rule("falha_tipo_pickup_datetime", "TIPO_PICKUP_INVALIDO", "qtd_erro_tipo_pickup",
         TYPE, "pickup_tipo_invalido", _uncastable(n.PICKUP), n.CLASS_TYPE),
    Rule("falha_tipo_dropoff_datetime", "TIPO_DROPOFF_INVALIDO", "qtd_erro_tipo_dropoff",
         TYPE, "dropoff_tipo_invalido", _uncastable(n.DROPOFF), n.CLASS_TYPE),
    Rule("falha_tipo_passenger_count", "TIPO_PASSENGER_INVALIDO", "qtd_erro_tipo_passenger",
         TYPE, "passenger_count_tipo_invalido", _uncastable(n.PASSENGERS), n.CLASS_TYPE),
    Rule("falha_tipo_total_amount", "TIPO_AMOUNT_INVALIDO", "qtd_erro_tipo_amount",
         TYPE, "total_amount_tipo_invalido", _uncastable(n.AMOUNT), n.CLASS_TYPE),
    Rule("falha_vendor_id_nulo", "VENDOR_ID_NULO", "qtd_vendor_id_nulo",
         NULL, "qtd_vendor_id_nulo", _absent(n.VENDOR), n.CLASS_NULL),
    Rule("falha_pickup_nulo", "PICKUP_NULO", "qtd_pickup_nulo",
         NULL, "qtd_pickup_nulo", _absent(n.PICKUP), n.CLASS_NULL),
    # Compatible behaviour: this flag never fires; the verdict still sees the NULL.
    Rule("falha_dropoff_nulo", "DROPOFF_NULO", "qtd_dropoff_nulo",
         NULL, "qtd_dropoff_nulo", _never, n.CLASS_NULL),
    Rule("falha_passenger_count_nulo", "PASSENGER_COUNT_NULO", "qtd_passenger_nulo",
         NULL, "qtd_passenger_nulo", _absent(n.PASSENGERS), n.CLASS_NULL),
    Rule("falha_total_amount_nulo", "TOTAL_AMOUNT_NULO", "qtd_amount_nulo",
         NULL, "qtd_amount_nulo", _absent(n.AMOUNT), n.CLASS_NULL),
    Rule("falha_vendor_id_invalido", "VENDOR_ID_FORA_RANGE", "qtd_vendor_id_invalido",
         RANGE, "vendor_fora_range", _negative(n.VENDOR)),
    Rule("falha_passenger_count_invalido", "PASSENGER_COUNT_FORA_RANGE", "qtd_passenger_invalido",
         RANGE, "passenger_fora_range", _negative(n.PASSENGERS)),
    Rule("falha_dropoff_antes_pickup", "DROPOFF_ANTES_PICKUP", "qtd_dropoff_antes_pickup",
         LOGIC, "dropoff_antes_pickup", _ends_before_start, n.CLASS_LOGIC),
    Rule("falha_duracao_excessiva", "DURACAO_EXCESSIVA", "qtd_duracao_excessiva",
         LOGIC, "viagens_muito_longas", _too_long, n.CLASS_LOGIC),
    Rule("falha_duracao_muito_curta", "DURACAO_MUITO_CURTA", "qtd_duracao_muito_curta",
         LOGIC, "viagens_muito_curtas", _too_short, n.CLASS_LOGIC),
    Rule("falha_pickup_futuro", "PICKUP_DATA_FUTURA", "qtd_pickup_futuro",
         LOGIC, "datas_futuras", _in_future),
    Rule("falha_pickup_muito_antigo", "PICKUP_MUITO_ANTIGO", "qtd_pickup_muito_antigo",
         LOGIC, "datas_muito_antigas", _too_old),
]


def _documented() -> list[Rule]:
    """The documented pack: four flags agree with the verdict, and amounts get one."""
    changed = {
        "falha_dropoff_nulo": _absent(n.DROPOFF),
        "falha_vendor_id_invalido": _vendor_outside,
        "falha_passenger_count_invalido": _passengers_outside,
    }
    amount = Rule("falha_total_amount_invalido", "TOTAL_AMOUNT_FORA_RANGE", "qtd_amount_invalido",
                  RANGE, "amount_fora_range", _amount_outside)
    pack = []
    for r in CODED:
        check = changed.get(r.flag, r.fails)
        pack.append(Rule(r.flag, r.label, r.metric, r.report, r.report_name, check, r.error_class))
        if r.flag == "falha_passenger_count_invalido":
            pack.append(amount)
    return pack


PACKS = {"coded": CODED, "documented": _documented()}


def rules_of(pack: str) -> list[Rule]:
    if pack not in PACKS:
        raise ValueError(f"rule pack {pack!r} is not one of {sorted(PACKS)}")
    return PACKS[pack]


def verdict(trip: Trip) -> Column:
    """1 if anything is wrong with the row; the same in every pack."""
    unusable = [trip.value(c).isNull() for c in CORE_TYPES]
    checks = [_vendor_outside, _passengers_outside, _amount_outside,
              _ends_before_start, _too_long, _too_short, _in_future, _too_old]
    return as_flag(reduce(or_, unusable + [check(trip) for check in checks]))


def with_rules(df: DataFrame, limits: Limits, pack: str = "coded") -> DataFrame:
    """Every input column, one 0/1 flag per rule and the verdict."""
    trip = Trip(limits, tuple(df.columns))
    flags = [as_flag(r.fails(trip)).alias(r.flag) for r in rules_of(pack)]
    kept = [c for c in df.columns if c not in TYPE_FLAGS.values()]
    return df.select(*kept, *flags, verdict(trip).alias(n.VERDICT))


def reasons(pack: str = "coded") -> Column:
    """Labels of the raised flags in rule order; empty text where none is raised."""
    labels = [F.when(F.col(r.flag) == 1, F.lit(r.label)) for r in rules_of(pack)]
    return F.concat_ws(n.REASON_SEPARATOR, *labels)


def error_class(pack: str = "coded") -> Column:
    """First class with a raised flag, in the order type, null, logic; range for the rest."""
    chosen = F
    for name in (n.CLASS_TYPE, n.CLASS_NULL, n.CLASS_LOGIC):
        raised = [F.col(r.flag) == 1 for r in rules_of(pack) if r.error_class == name]
        chosen = chosen.when(reduce(or_, raised), F.lit(name))
    return chosen.otherwise(F.lit(n.CLASS_RANGE))


def valid_rows(flagged: DataFrame, *more: str) -> DataFrame:
    """The trusted columns of the rows without error, and ``more`` of theirs."""
    typed = {c: F.col(c).cast("int" if c == n.VENDOR else CORE_TYPES[c]) for c in n.CORE}
    typed[n.VENDOR] = typed[n.VENDOR].cast("bigint")
    return flagged.where(F.col(n.VERDICT) == 0).select([typed[c].alias(c) for c in n.CORE] + [F.col(c) for c in more])


def quarantine_rows(flagged: DataFrame, limits: Limits, pack: str = "coded") -> DataFrame:
    """Rows with an error, stamped with moment, reasons, class and day."""
    return flagged.where(F.col(n.VERDICT) == 1).select(
        "*",
        limits.now.alias(n.STAMP),
        reasons(pack).alias(n.REASONS),
        error_class(pack).alias(n.ERROR_CLASS),
        limits.today.alias(n.QUARANTINE_DAY),
    )
