import json

import pytest

from chainfold import cli
from chainfold.functions.keccak import checksummed
from chainfold.plans.erc20 import TRANSFER
from chainfold.sources.receipts import rlp_encode
from chainfold.sources.schemas import FINALITY
from tests.chain import addr, word

TOKEN = addr(0xAE)


def test_commands(spark, tmp_path, capsys):
    def block(n, value):
        log = [TOKEN, [TRANSFER.topic0, word(addr(1)), word(addr(2))], word(value)]
        return n, rlp_encode([[b"", b"\x01", addr(1), [log]]]), rlp_encode([bytes(32)] * 11 + [1_700_000_000 + n])

    spark.createDataFrame([block(n, n) for n in range(10, 20)], "block_number long, receipts binary, header binary").write.parquet(f"{tmp_path}/dump")
    store, out = f"{tmp_path}/store", f"{tmp_path}/out"
    assert cli.main(["import", f"{tmp_path}/dump", store, "--head", str(18 + FINALITY)], spark) == "last final block: 18"
    assert json.loads(cli.main(["status", store], spark).splitlines()[0])["rows"] == 9
    token = checksummed(TOKEN)
    assert json.loads(cli.main(["run", store, out, token], spark))["counts"] == {"transfers": 9, "approvals": 0}
    assert json.loads(cli.main(["ask", store, out, token, "account", addr(2).hex()], spark))["balance"] == str(sum(range(10, 19)))
    assert [t["value"] for t in json.loads(cli.main(["ask", store, out, token, "transfers", "--limit", "2"], spark))] == ["18", "17"]
    with pytest.raises(ValueError):
        cli.main(["run", store, out, token.lower()], spark)
