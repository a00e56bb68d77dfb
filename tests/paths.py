"""Where the tests find the driver's tables (a module of its own: the name
``conftest`` belongs to every folder of tests)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
