"""Expressions over workload specs: resource sums, volumes, text bundle, canonical JSON and hash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wattloom.functions.quantities import to_int

# Volume kinds, in priority order, with the spelling of client-library dumps.
VOLUME_KINDS = {
    "emptyDir": "empty_dir",
    "hostPath": "host_path",
    "persistentVolumeClaim": "persistent_volume_claim",
    "configMap": "config_map",
    "secret": "secret",
    "downwardAPI": "downward_api",
    "projected": "projected",
    "nfs": "nfs",
    "ephemeral": "ephemeral",
}
# Node-selector labels that carry the instance type.
NODE_TYPE_LABELS = ("node.kubernetes.io/instance-type", "beta.kubernetes.io/instance-type")
RESOURCES = ("req_cpu_mcpu", "req_mem_mib", "lim_cpu_mcpu", "lim_mem_mib")


def volume_type(volume: Column) -> Column:
    """Kind of one volume, given as map<string,string>; a null source counts as absent."""
    kinds = [
        F.when(F.coalesce(volume[camel], volume[snake]).isNotNull(), F.lit(camel))
        for camel, snake in VOLUME_KINDS.items()
    ]
    return F.coalesce(*kinds, F.lit("other"))


def volume_types(volumes: Column) -> Column:
    return F.coalesce(F.transform(volumes, volume_type), F.array().cast("array<string>"))


def node_type(selector: Column) -> Column:
    return F.coalesce(*[F.nullif(selector[label], F.lit("")) for label in NODE_TYPE_LABELS])


def gpu_count(limits: Column) -> Column:
    """Sum over containers (array of map<string,string>) of the limits whose name holds ``gpu``."""
    matching = F.flatten(
        F.transform(
            F.filter(limits, lambda m: m.isNotNull()),
            lambda m: F.map_values(F.map_filter(m, lambda k, _: k.contains("gpu"))),
        )
    )
    total = F.aggregate(matching, F.lit(0), lambda s, v: s + F.coalesce(to_int(v), F.lit(0)))
    return F.coalesce(total, F.lit(0))


def resource_sum(containers: Column, field: str) -> Column:
    """Sum of a resource over a request's containers; nulls skipped, no container gives 0."""
    return F.coalesce(
        F.aggregate(
            containers,
            F.lit(0.0),
            lambda s, c: s + F.coalesce(c[field].cast("double"), F.lit(0.0)),
        ),
        F.lit(0.0),
    )


def _sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def _present(prefix: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(prefix), value))


def _no_parts() -> Column:
    return F.array().cast("array<string>")


def text_bundle(
    kind: Column, name: Column, labels: Column, annotations: Column, containers: Column
) -> Column:
    """The words of a spec as one line, parts joined by `` | ``; ``empty`` when there are none."""

    def entries(m: Column, prefix: str) -> Column:
        parts = F.transform(
            _sorted_entries(m),
            lambda e: F.concat(F.lit(prefix), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))),
        )
        return F.coalesce(parts, _no_parts())

    per_container = F.transform(
        containers,
        lambda c: F.array(
            _present("image:", c["image"]),
            _present("command:", F.array_join(c["command"], " ")),
            _present("args:", F.array_join(c["args"], " ")),
        ),
    )
    parts = F.concat(
        F.array(_present("workload_kind:", kind), _present("workload_name:", name)),
        entries(labels, "label:"),
        entries(annotations, "ann:"),
        F.coalesce(F.flatten(per_container), _no_parts()),
    )
    line = F.array_join(parts, " | ")  # skips null parts
    return F.when(line == "", F.lit("empty")).otherwise(line)


# --- canonical JSON: keys sorted, ", " and ": " between, everything outside ASCII escaped ---

# The short escapes of JSON strings.
_SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escape_char(c: Column) -> Column:
    utf16 = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    # one code unit, or a pair of them; an empty piece stays empty
    escaped = F.regexp_replace(utf16, "(.{4})", r"\\u$1")
    short = F.create_map(*[F.lit(x) for pair in _SHORT_ESCAPES.items() for x in pair])
    return F.coalesce(short[c], F.when(c.rlike("^[ -~]$"), c).otherwise(escaped))


def json_string(s: Column) -> Column:
    """JSON text of a string; only strings that need escapes are taken apart."""
    body = F.when(
        s.rlike(r'[^ -~]|["\\]'), F.array_join(F.transform(F.split(s, ""), _escape_char), "")
    ).otherwise(s)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _json_number(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit("null"))


def _json_array(items: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), F.lit("null"))


def _json_strings(items: Column) -> Column:
    return _json_array(F.transform(items, json_string))


def _json_object(fields: dict[str, Column]) -> Column:
    parts = [x for name in sorted(fields) for x in (F.lit(f', "{name}": '), fields[name])]
    parts[0] = F.lit(f'{{"{min(fields)}": ')
    return F.concat(*parts, F.lit("}"))


def _json_texts(texts: dict[str, Column]) -> dict[str, Column]:
    """Several strings escaped by one lambda, which keeps the plan small."""
    escaped = F.transform(F.array(*texts.values()), json_string)
    return {name: escaped[i] for i, name in enumerate(texts)}


def _json_map(m: Column) -> Column:
    entries = F.transform(
        _sorted_entries(m),
        lambda e: F.array_join(F.transform(F.array(e["key"], e["value"]), json_string), ": "),
    )
    return F.coalesce(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")), F.lit("null"))


def _json_container(c: Column) -> Column:
    fields = _json_texts({name: c[name] for name in ("name", "image")})
    fields |= {name: _json_strings(c[name]) for name in ("command", "args")}
    fields |= {name: _json_number(c[name]) for name in RESOURCES}
    return _json_object(fields)


def canonical_json(request: Column | None = None) -> Column:
    """Key-sorted JSON of a defaulted request row (its columns, or a struct of them)."""

    def field(name: str) -> Column:
        return F.col(name) if request is None else request[name]

    texts = ("schema_version", "namespace", "workload_kind", "workload_name", "node_type", "runtime_class")
    numbers = ("init_container_count", "sidecar_count", "gpu_count", "parallelism", "completions")
    fields = _json_texts({name: field(name) for name in texts})
    fields |= {name: _json_number(field(name)) for name in numbers}
    fields |= {name: _json_map(field(name)) for name in ("labels", "annotations")}
    fields["containers"] = _json_array(F.transform(field("containers"), _json_container))
    fields["volume_types"] = _json_strings(field("volume_types"))
    return _json_object(fields)


def spec_hash(request: Column | None = None) -> Column:
    """First 16 hex digits of the SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(request), 256), 1, 16)

