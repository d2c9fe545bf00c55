from quillsift import shipping


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    shipping._SHIPPED.discard(spark.sparkContext.applicationId)
    old = spark.conf.get(shipping.BATCH)
    spark.conf.unset(shipping.BATCH)
    shipping.ship(spark)
    assert spark.conf.get(shipping.BATCH) == f"{shipping.BATCH_BYTES}b"
    spark.conf.set(shipping.BATCH, "1000000b")
    shipping._SHIPPED.discard(spark.sparkContext.applicationId)
    shipping.ship(spark)
    assert spark.conf.get(shipping.BATCH) == "1000000b"
    spark.conf.set(shipping.BATCH, old)
