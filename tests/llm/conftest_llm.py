"""Where the tests of this folder read the given tables."""
SF = "/root/testdata/sf0.001"
