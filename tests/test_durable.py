from gridwright.plans.durable import keep, remove_kept, shared_dir, tables_dir


def test_only_tables_of_this_application_are_removed(spark):
    other = f"{shared_dir(spark)}/tables/another-application/t"
    spark.range(3).write.mode("overwrite").parquet(other)
    kept = keep(spark.range(5))
    assert kept.count() == 5 and all(tables_dir(spark) in f for f in kept.inputFiles())
    remove_kept(spark)
    assert spark.read.parquet(other).count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
