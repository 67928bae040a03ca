"""Folders of the given tables; a module of its own, since every folder of tests has a conftest."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
