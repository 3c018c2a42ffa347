"""Who is involved in a message."""

from pyspark.sql import Column, DataFrame, functions as F

from letterlens.scale import join_counted, materialize

ROLES = ("from", "to", "cc", "reply_to")
SALTS = 32


def normal_address(address: Column) -> Column:
    return F.lower(F.trim(address))


def check_target(target: str) -> str:
    target = target.lower().strip()
    if "@" not in target:
        raise ValueError(f"not an address: {target!r}")
    return target


def involves(target: str, from_only: bool = False) -> Column:
    """The address is the sender's; or, unless from_only, any of From, To, Cc or Reply-To."""
    found = F.lit(False)
    for role in ROLES[:1] if from_only else ROLES:
        found = found | F.array_contains(F.col(f"{role}_addrs"), check_target(target))
    return found


def of_target(messages: DataFrame, target: str | None, from_only: bool = False) -> DataFrame:
    return messages.filter(involves(target, from_only)) if target else messages


def address_roles(messages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per message, role and address."""

    def listed(role: str) -> Column:
        return F.transform(F.col(f"{role}_addrs"), lambda a: F.struct(F.lit(role).alias("role"), a.alias("address")))

    lists = [listed(role) for role in ROLES]
    return messages.select(*keys, F.inline(F.flatten(F.array(*lists))))


def of_any_target(messages: DataFrame, keys: list[str], targets: DataFrame, from_only: bool = False) -> DataFrame:
    """Messages that involve any address of a target table (column address) of any size.

    One mailing-list address may occur in a third of all messages, so addresses are salted before
    they are joined. Only keys travel: whole messages stay where they are read, unless more than BROADCAST_ROWS of them
    are found.
    """
    roles = address_roles(messages, keys).filter((F.col("role") == "from") | F.lit(not from_only))
    wanted = (
        targets.select(normal_address(F.col("address")).alias("address"))
        .filter(F.col("address").contains("@"))
        .distinct()
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = roles.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    hits = materialize(salted.join(wanted, ["address", "salt"], "left_semi").select(*keys).distinct(), "hits")
    return join_counted(messages, hits, keys, "left_semi")


ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def addresses_in_text(text: Column) -> Column:
    """Lower-case addresses written in running text."""
    return F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), 0), F.lower)
