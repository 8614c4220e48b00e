"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeharbor.functions.text import empty_to_null, strip


def source_type(source: Column) -> Column:
    """job, workspace or local, from what a user typed."""
    return (
        F.when(F.rlike(source, F.lit(r"^[0-9]+\z")), "job")
        .when(F.startswith(source, F.lit("/Workspace")) | F.startswith(source, F.lit("/Repos")), "workspace")
        .when(F.rlike(source, F.lit(r"^(/|\./|\.\.)")), "local")
        .when(job_id(source).isNotNull(), "job")
        .otherwise("workspace")
    )


def job_id(source: Column) -> Column:
    """A whole number, or NULL; blanks around it, a sign and digit groups by '_' are fine."""
    text = strip(source)
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(F.rlike(text, F.lit(r"^[+-]?[0-9]+(?:_[0-9]+)*\z")), digits.try_cast("bigint"))


def bundle_name(source: Column, kind: Column) -> Column:
    """'job-<id>-bundle', or the stem of the last path part in kebab case, or 'bundle'."""
    whole = F.regexp_replace(source, r"(?:/+\.?)*\z", "")  # closing slashes and parts that are one dot are no names
    last = F.regexp_extract(whole, r"[^/]*\z", 0)
    stem = F.regexp_replace(last, r"([^.])\.[^.]+\z", "$1")
    kebab = F.regexp_replace(F.lower(stem), r"[_\s]+", "-")
    kebab = F.regexp_replace(kebab, "[^a-z0-9-]", "")
    kebab = F.btrim(F.regexp_replace(kebab, "-+", "-"), F.lit("-"))
    return F.when(kind == "job", F.concat(F.lit("job-"), source, F.lit("-bundle"))).otherwise(
        F.coalesce(empty_to_null(kebab), F.lit("bundle"))
    )


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def bundle_dir(path: Column) -> Column:
    """The folder of a config file; any other path is a folder already."""
    return F.when(F.rlike(path, F.lit(r"\.ya?ml$")), parent_dir(path)).otherwise(path)


def join_path(base: Column, name: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), name)


def upload_path(base: Column, user: Column, name: Column) -> Column:
    """Where a bundle goes: the given base, else the user's own bundle folder."""
    own = F.concat(F.lit("/Workspace/Users/"), user, F.lit("/bundles"))
    return join_path(F.coalesce(empty_to_null(base), own), name)


def resolve(caller: Column, callee: Column) -> Column:
    """Absolute path of a callee named relative to the caller's folder ('./', '../', plain)."""
    absolute = F.when(F.startswith(callee, F.lit("/")), callee).otherwise(join_path(parent_dir(caller), callee))
    parts = F.filter(F.split(absolute, "/"), lambda part: ~part.isin("", "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.array_append(done, part)),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")
