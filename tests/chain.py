"""Hand-made logs for tests."""

from chainfold.functions.abi import encode_arg
from chainfold.plans.erc20 import APPROVAL, TRANSFER
from chainfold.sources.schemas import BLOCKS, LOGS

ZERO = bytes(20)


def addr(n: int) -> bytes:
    return bytes([n]) * 20


def word(x) -> bytes:
    return encode_arg(x)


def transfer(block, source, target, value, token=addr(0xAE), log=0, tx=0):
    return (block, tx, log, token, [TRANSFER.topic0, word(source), word(target)], TRANSFER.topic0, word(value), None)


def approval(block, owner, spender, value, token=addr(0xAE), log=0, tx=0):
    return (block, tx, log, token, [APPROVAL.topic0, word(owner), word(spender)], APPROVAL.topic0, word(value), None)


def logs_of(spark, rows):
    return spark.createDataFrame(rows, LOGS)


def blocks_of(spark, numbers, salt=b"", parent=None):
    """Blocks whose hashes end in salt; the first one's parent ends in `parent`, if that is given."""
    numbers = list(numbers)
    before = lambda n: salt if parent is None or n != numbers[0] else parent
    rows = [(n, f"h{n}".encode() + salt, f"h{n - 1}".encode() + before(n), 1_700_000_000 + 12 * n) for n in numbers]
    return spark.createDataFrame(rows, BLOCKS)


def number(raw) -> int:
    return int.from_bytes(raw, "big")
