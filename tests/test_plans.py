"""Plans: no query may fall back from compiled to interpreted stages."""

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_fallback(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    yield
    spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("name", ["top_links_per_page", "page_links", "social_profiles", "profile_pages", "platform_counts", "html_pages", "channel_pages", "browser_urls", "contact_rules", "nested_sitemaps", "feed_signals"])
def test_stages_compile(spark, no_fallback, name):
    entry.queries()[name](spark, DIR).write.format("noop").mode("overwrite").save()
