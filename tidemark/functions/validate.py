"""Validation: each builder gives null or the first broken rule, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codec
from tidemark.schema import (
    BASE58_RUN,
    MAX_APP_NAME,
    MAX_APP_SLUG,
    MAX_EXT_BYTES,
    MAX_EXT_KEY,
    MAX_EXT_KEYS,
    MAX_RESOURCE,
    MAX_SNIPPET,
    MAX_TAG,
    MAX_TAGS,
    MAX_TEMPLATE,
    MAX_TITLE,
    MAX_URL,
    MAX_VERSION,
    MAX_VOCAB,
)


@F.pandas_udf(T.StringType())
def path_reason(paths):
    import pandas as pd

    return pd.Series([None if p is None else codec.path_reason(p) for p in paths], dtype=object)


@F.pandas_udf(T.BooleanType())
def decoded_control(texts):
    import pandas as pd

    return pd.Series([False if t is None else codec.control_reason(t) for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def well_formed_subject(ids):
    import pandas as pd

    return pd.Series([codec.well_formed_subject(i) for i in ids], dtype=object)


@F.pandas_udf(T.BinaryType())
def wire_bytes(bodies):
    """codec.record_bytes of bodies in JSON."""
    import json

    import pandas as pd

    return pd.Series([codec.record_bytes(json.loads(b)) for b in bodies], dtype=object)


@F.pandas_udf(T.BooleanType())
def signature_ok(keys, messages, sigs):
    import pandas as pd

    return pd.Series(codec.verify_all(list(keys), list(messages), list(sigs)), dtype=object)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that is broken; what can't be told, as where a field is null, counts as broken."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(reason)) for broken, reason in rules))


def bad_vocabulary(c: Column) -> Column:
    return F.coalesce(~F.octet_length(c).between(1, MAX_VOCAB) | ~c.rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(True))


def bad_slug(c: Column) -> Column:
    return ~F.octet_length(c).between(1, MAX_APP_SLUG) | ~c.rlike(r"\A[a-z0-9-]+\z")


def bad_display(c: Column, most: int = MAX_APP_NAME) -> Column:
    return ~F.octet_length(c).between(1, most) | ~c.rlike(r'\A[ !#-\[\]-~]+\z')


def raw_control(c: Column) -> Column:
    return c.rlike(r"\p{Cc}")


def ext_bytes(ext: Column) -> Column:
    """Bytes of all keys and values."""
    return F.aggregate(F.map_entries(ext), F.lit(0), lambda n, p: n + F.octet_length(p["key"]) + F.octet_length(p["value"]))


def ext_rules(ext: Column) -> list[tuple[Column, str]]:
    """No map at all is a legal one."""
    pairs = F.map_entries(ext)
    rules = [
        (F.size(ext) > MAX_EXT_KEYS, "too many ext keys"),
        (F.exists(pairs, lambda p: ~F.octet_length(p["key"]).between(1, MAX_EXT_KEY) | raw_control(p["key"]) | raw_control(p["value"])), "ext entry"),
        (ext_bytes(ext) > MAX_EXT_BYTES, "ext total"),
    ]
    return [(ext.isNotNull() & broken, reason) for broken, reason in rules]


def locator_reason(at: Column, guard_paths: bool = True) -> Column:
    """First broken rule of a locator; whether the app is registered is deliberately not asked."""
    base58 = lambda c: c.rlike(rf"\A{BASE58_RUN}+\z")
    contract = first_reason((~F.octet_length(at["contract_id"]).isin(43, 44), "contract id length"), (~base58(at["contract_id"]), "contract id charset"))
    url = [(~at["url"].startswith("https://"), "not https"), (F.octet_length(at["url"]) > MAX_URL, "url length")]
    app = first_reason((bad_slug(at["app"]), "app slug"), (~F.octet_length(at["resource"]).between(1, MAX_RESOURCE), "resource length"), (~base58(at["resource"]), "resource charset"))
    path = F.when(at["path"].isNull(), "no path")
    if guard_paths:
        path = F.coalesce(path, path_reason(at["path"]))
    if guard_paths:
        url.append((decoded_control(at["url"]), "url control character"))
    return (
        F.when(at["variant"] == "Contract", F.coalesce(contract, path))
        .when(at["variant"] == "External", first_reason(*url))
        .when(at["variant"] == "AppResource", F.coalesce(app, path))
        .otherwise("unknown variant")
    )


def record_reason(version: Column, subject_ok: Column, is_tomb: Column, e: Column, guard_paths: bool = True) -> Column:
    """First broken rule of a record's structure. Tombstones have a version and an id only; what isn't said to be one is none."""
    head = first_reason((~version.between(1, MAX_VERSION), "version"), (~subject_ok, "subject id"))
    body = F.coalesce(
        first_reason(
            (~F.octet_length(e["title"]).between(1, MAX_TITLE), "title length"),
            (F.octet_length(e["snippet"]) > MAX_SNIPPET, "snippet length"),
            (raw_control(e["title"]), "title control character"),
            (raw_control(e["snippet"]), "snippet control character"),
            (F.coalesce(F.exists(e["tags"], raw_control), F.lit(False)), "tag control character"),
            ((F.size(e["tags"]) > MAX_TAGS) | F.exists(e["tags"], lambda t: F.octet_length(t) > MAX_TAG), "tags"),
            (bad_vocabulary(e["kind"]), "kind"),
            (e["class"].isNotNull() & bad_vocabulary(e["class"]["landing"]), "landing"),
            (e["class"].isNotNull() & bad_vocabulary(e["class"]["volatility"]), "volatility"),
            (e["verified"].isNotNull() & bad_vocabulary(e["verified"]["status"]), "status"),
            *ext_rules(e["ext"]),
            (e["featured"].isNull() | e["added_at"].isNull(), "missing field"),
        ),
        locator_reason(e["locator"], guard_paths),
    )
    return F.coalesce(head, F.when(~F.coalesce(is_tomb, F.lit(False)), body))


def app_reason(slug: str, contract_id: str, name: str, link_template: str) -> str | None:
    """First broken rule of a registered app; a registry has 64 rows at most, so this is plain Python."""
    import re

    template = link_template

    if not re.fullmatch(rf"[a-z0-9-]{{1,{MAX_APP_SLUG}}}", slug):
        return "app slug"
    if len(contract_id) not in (43, 44):
        return "contract id length"
    if not re.fullmatch(f"{BASE58_RUN}+", contract_id):
        return "contract id charset"
    if not re.fullmatch(rf"[ !#-\[\]-~]{{1,{MAX_APP_NAME}}}", name):
        return "app name"
    if not 1 <= len(template.encode()) <= MAX_TEMPLATE:
        return "template length"
    if not re.fullmatch(r"[a-zA-Z0-9/_.~#?=&+,{}-]+", template):
        return "template charset"
    if not template.startswith("/"):
        return "template start"
    if "{resource}" not in template:
        return "no {resource}"
    if "{path}" not in template:
        return "no {path}"
    if template.find("{path}") < template.find("{resource}"):
        return "{path} before {resource}"
    if not template.endswith("{path}"):
        return "{path} not last"
    probe = template.replace("{resource}", "1").replace("{path}", "")
    reason = codec.path_reason(template) or codec.path_reason(probe)
    if reason:
        return reason
    if re.search(r"[{}]", template.replace("{resource}", "").replace("{path}", "")):
        return "unknown placeholder"
    return None
