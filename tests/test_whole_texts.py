"""Queries of detectors over tables read whole texts."""

from sessionlens.plans import queries


def test_test_integrity_against_a_loop(spark, tmp_path):
    ids = [*range(0, 40), *range(500, 530), 1030]
    docs = [(i, "ab"[i % 7 == 0], "word " * 60 + f"def test_{i}(self): self.assertTrue(x)") for i in ids]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    edits = {r.uuid: r for r in queries.weakening_edits(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("kind = 'tool_call'").collect()}
    for i, _, text in docs:
        assert (edits[str(i)].old_string, edits[str(i)].new_string) == ("self.assertEqual(a, b)\n" + text, text)
    assert {r.session_id for r in edits.values()} == {f"{s}:{i // 512}" for i, s, _ in docs}
    expected = []
    for i, s, _ in docs:
        before = [j for j, t, _ in docs if t == s and j // 512 == i // 512 and i - 5 <= j <= i and j % 9 == 0]
        expected.append((f"{s}:{i // 512}", 2 if before else 1))
    got = queries.d2_test_integrity(spark, str(tmp_path)).collect()
    assert sorted((r.session_id, r.severity) for r in got) == sorted(expected)
    assert {r.severity for r in got} == {1, 2}
    # the last text has one assertTrue more than its first 200 characters, and so has each side of its edit
    assert all("1 assertion(s) removed" in r.title for r in got)


def test_page_files_hold_whole_pages(spark):
    html = "<p>" + "x" * 9000 + "\ndef no(x):\nconst no = 1;\n</p>"
    files = {r.path: r.text for r in queries.page_files(spark.createDataFrame([(1, html), (2, html), (3, None)], "page_id long, html string")).collect()}
    assert html.replace("\n", "\n// ") in files["/repo/f1.ts"] and html.replace("\n", "\n# ") in files["/repo/f2.py"]


def test_comments_declare_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "u", "a\nconst no = 1;"), (2, "u", "b\ndef no(x):")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.name for r in queries.x7_declared_names(spark, str(tmp_path)).collect()} == {"f1_ts", "f2"}


def test_patterns_need_their_words(spark):
    """Texts without a needed word are not put through the regex engine, and counts are those of the engine all the same."""
    from pyspark.sql import functions as F

    from sessionlens.functions import patterns as P
    from sessionlens.functions import rx
    from sessionlens.operators import weakening

    texts = ["t.Errorf( t.Fail t.Fatalf t.Skip( t.SkipNow(", "assert.Equal(a) require.NotNil(b) assert.True(c)", "  assert x", "self.assertEquals( self.assertEqual( self.assertTrue(", "expect(a).toEqual(b) expect(a).toBeTruthy() .toBeDefined( .toStrictEqual(", "EXPECT_EQ( ASSERT_X(", "func TestA( def test_b( it( 'x' test(\"y\" @Test @Tests"]
    texts += ["@pytest.mark.skip @unittest.skip pytest.skip( xit( xdescribe( it.skip( test.skip( describe.skip( @Disabled @Ignore #[ignore]", "assert", "t.Fa t.Err", "", None]
    patterns = [*P.DECLARATIONS, *P.SKIPS, *P.ASSERTIONS, *(x for s, w, _ in P.WEAKENINGS for x in (s, w))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*[F.array(weakening.times(F.col("t"), p), rx.count(F.col("t"), p)).alias(f"c{i}") for i, p in enumerate(patterns)]).collect()
    assert all(a == b for r in got for a, b in r) and all(any(r[i][0] for r in got) for i in range(len(patterns)))
    plan = df.select(weakening.reasons(F.col("t"), F.lit("x"))).where("true")._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.lower().count(f"contains(t#") and w in plan for p in patterns for w in P.NEEDED[p])
