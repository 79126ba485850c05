"""No credential's value is left in a log."""

import pytest
from pyspark.sql import functions as F

from hearsay.functions import text as tx


@pytest.mark.parametrize(
    "message, want",
    [
        ("api_key: abc failed", "api_key=<redacted> failed"),
        ("API KEY = abc, next", "API KEY=<redacted>, next"),
        ("Authorization: Bearer abc.def sent", "Authorization=<redacted> sent"),
        ("header bearer abc", "header authorization=<redacted>"),
        ("https://x/?a=1&access_token=abc&b=2", "https://x/?a=1&access_token=<redacted>&b=2"),
        ("mytoken=abc;rest", "mytoken=<redacted>;rest"),
        ("the password hunter2 was", "the credential=<redacted> was"),
        ("used sk-abcdefgh12 twice", "used <redacted> twice"),
        ("sk-short stays", "sk-short stays"),
        ("  \n ", "<no detail>"),
        (None, "<no detail>"),
        ("nothing\tto   hide", "nothing to hide"),
    ],
)
def test_redacted(spark, message, want):
    got = spark.createDataFrame([(message,)], "m string").select(tx.redacted(F.lit("ValueError"), F.col("m")), tx.redacted(F.lit(None).cast("string"), F.col("m"), 9)).collect()[0]
    assert got[0] == f"ValueError: {want}" and got[1] == f"Error: {want}"[:9]
