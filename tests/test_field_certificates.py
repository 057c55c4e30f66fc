from packetloom.sources.fields import with_certificates


def test_validity_under_either_name(spark, packets):
    pk = packets([{"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2"} for _ in range(3)])
    rows = spark.createDataFrame(
        [("1", "CN=a|CN=b", None, "n1|n2", "2030", None), ("2", None, "u1", "ignored", None, "g1"), ("3", "", None, None, None, None)],
        "`frame.number` string, `x509af.subject` string, `x509af.utcTime` string, `x509af.notBefore` string, "
        "`x509af.notAfter` string, `x509af.generalizedTime` string").withColumn("x509af.serialNumber", _serial())
    found = {r.frame_number: [(c.subject, c.not_before, c.not_after) for c in r.tls_certificates or []]
             for r in with_certificates(pk, rows).collect()}
    assert found == {1: [("CN=a", "n1", "2030"), ("CN=b", "n2", None)], 2: [(None, "u1", "g1")], 3: []}


def _serial():
    from pyspark.sql import functions as F

    return F.when(F.col("`frame.number`") == "2", "07")
