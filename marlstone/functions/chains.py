"""Operator chains: signatures, keys, and the predicates that relate two chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import buckets
from .text import bound, clean, strip

OPERATOR = "array<struct<op:string,codec:string,bitrate:string,encode_sample_rate:string,loss_rate_pct:string,concealment:string,mode:string,snr_db:string,noise_type:string,rt60:string,distance:string,room:struct<name:string,room_dim:array<double>>,backend:string,profile:string,agc_profile:string,jitter_ms:string>>"


def parse_names(text: Column) -> Column:
    """A JSON list as strings; what isn't one is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def parse_operators(text: Column) -> Column:
    """A JSON list of objects as structs; what isn't one is empty, entries that aren't objects go."""
    entries = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    objects = F.filter(entries, lambda x: x.startswith("{"))
    parsed = F.transform(objects, lambda x: F.from_json(x, OPERATOR.removeprefix("array<").removesuffix(">")))
    return F.coalesce(F.filter(parsed, lambda o: o.isNotNull()), F.array().cast(OPERATOR))


#: Fields of an operator that its token may need; a struct of operators has any of them.
FIELDS = ("codec", "bitrate", "encode_sample_rate", "loss_rate_pct", "concealment", "mode", "snr_db", "noise_type", "rt60", "distance", "room", "profile", "agc_profile", "jitter_ms")


def token(op: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """name[part,...], the parts of the operator's kind sorted; the bare name where there is none. ``fields`` are those that the struct has."""

    def part(name: str, field: str, shown) -> Column:
        """Null if the value is."""
        if field not in fields:
            return F.lit(None).cast("string")
        return F.concat(F.lit(name + "="), shown(op[field]["name"] if field == "room" else op[field]))

    plain, scaled = lambda x: clean(x.cast("string")), lambda scale: lambda x: buckets.bucket(x, scale)
    codec = [part("codec", "codec", plain), part("bitrate", "bitrate", buckets.bitrate_bucket), part("encode_sr", "encode_sample_rate", scaled(buckets.SAMPLE_RATE))]
    loss = [part("plr", "loss_rate_pct", scaled(buckets.PACKET_LOSS)), part("concealment", "concealment", plain)]
    kinds = {
        "packet_loss": loss,
        "bandlimit": [part("bandwidth", "mode", plain)],
        "resample": [part("resample", "mode", plain)],
        "noise": [part("snr", "snr_db", scaled(buckets.SNR)), part("noise", "noise_type", plain)],
        "rir": [part("rt60", "rt60", scaled(buckets.RT60)), part("distance", "distance", scaled(buckets.DISTANCE)), part("room", "room", plain)],
        "call_path": [part("profile", "profile", plain), codec[0], codec[2], *loss, part("agc", "agc_profile", plain), part("jitter", "jitter_ms", buckets.compact_number)],
    }

    def named(name: Column) -> Column:
        parts = F.when(name.isin("codec", "reencode"), F.array(*codec))
        for kind, own in kinds.items():
            parts = parts.when(name == kind, F.array(*own))
        parts = F.sort_array(F.filter(parts.otherwise(F.array().cast("array<string>")), lambda p: p.isNotNull()))
        return bound(parts, lambda own: F.when(F.size(own) > 0, F.concat(name, F.lit("["), F.array_join(own, ","), F.lit("]"))).otherwise(name))

    return bound(strip(op["op"]), lambda name: named(F.nullif(name, F.lit(""))))


def tokens(operators: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Tokens of an array of operator structs; operators without a name have none."""
    return F.filter(F.transform(operators, lambda o: token(o, fields)), lambda t: t.isNotNull())


def signature(operator_params: Column, operator_seq: Column) -> Column:
    """Tokens of the parameters; of the names where there are no parameters."""
    found = tokens(parse_operators(operator_params))
    return F.when(F.size(found) > 0, found).otherwise(parse_names(operator_seq))


def multiset_key(sig: Column) -> Column:
    """The sorted signature as compact JSON; empty for an empty one."""
    return F.when(F.size(sig) > 0, F.to_json(F.array_sort(sig))).otherwise("")


def endpoint_key(sig: Column) -> Column:
    return F.coalesce(F.try_element_at(sig, F.lit(-1)), F.lit(""))


def operator_name(token: Column) -> Column:
    return strip(F.substring_index(token, "[", 1))


def differences(a: Column, b: Column) -> Column:
    """Zero-based slots in which two chains of equal length differ."""
    flags = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.lit(1)) - 1), lambda i: F.coalesce(F.get(flags, i), F.lit(False)))


def _same_length(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def one_slot_axis(a: Column, b: Column) -> Column:
    """``parameter@i`` or ``operator@i`` if exactly one slot differs, else null."""
    d = differences(a, b)
    i = F.get(d, F.lit(0))
    same = operator_name(F.get(a, i)) == operator_name(F.get(b, i))
    return F.when(_same_length(a, b) & (F.size(d) == 1), F.concat(F.when(same, "parameter@").otherwise("operator@"), i.cast("string")))


def substitution_detail(a: Column, b: Column) -> Column:
    """``indices=i,j`` if some slots differ and each of them in the operator's name, else null."""
    d = differences(a, b)
    named = F.forall(d, lambda i: operator_name(F.get(a, i)) != operator_name(F.get(b, i)))
    return F.when(_same_length(a, b) & (F.size(d) > 0) & named, F.concat(F.lit("indices="), F.array_join(d.cast("array<string>"), ",")))


def named_slots(chain: Column) -> Column:
    """A chain's tokens with their operators' names, so that a name is cut once for a chain, not for a pair."""
    return F.transform(chain, lambda t: F.struct(operator_name(t).alias("name"), t.alias("token")))


def slots_detail(a: Column, b: Column) -> Column:
    """``substitution_detail`` of the named slots of two chains of one length."""
    alike, other, same_name = 0, 1, 2
    marks = F.zip_with(a, b, lambda x, y: F.when(x["token"].eqNullSafe(y["token"]), alike).when(x["name"] != y["name"], other).otherwise(same_name))
    shown = lambda m: F.concat(F.lit("indices="), F.array_join(F.filter(F.transform(m, lambda x, i: F.when(x == other, i.cast("string"))), lambda x: x.isNotNull()), ","))
    return bound(marks, lambda m: F.when(F.array_contains(m, other) & ~F.array_contains(m, same_name), shown(m)))


def swap_gap(a: Column, b: Column) -> Column:
    """Distance of the two slots that are each other's, null if the chains aren't a swap."""
    d = differences(a, b)
    i, j = F.get(d, F.lit(0)), F.get(d, F.lit(1))
    crossed = (F.get(a, i) == F.get(b, j)) & (F.get(a, j) == F.get(b, i))
    return F.when(_same_length(a, b) & (F.size(d) == 2) & crossed, j - i)


def without(chain: Column, i: Column) -> Column:
    return F.concat(F.slice(chain, F.lit(1), i), F.slice(chain, i + 2, F.size(chain)))


def reorder(operators: Column, names: Column) -> Column:
    """Operator structs in the order of ``names``; an error where the names aren't the operators', each once."""
    own = F.transform(operators, lambda o: o["op"])
    same = (F.size(F.array_distinct(own)) == F.size(own)) & (F.array_sort(own) == F.array_sort(names))
    placed = F.transform(names, lambda n: F.get(F.filter(operators, lambda o: o["op"] == n), F.lit(0)))
    return F.when(same, placed).otherwise(F.raise_error(F.concat(F.lit("no such order of operators: "), F.array_join(names, ","))))


def names_of(operators: Column) -> Column:
    return F.transform(operators, lambda o: o["op"])
