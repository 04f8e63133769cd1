"""Reading and writing of domain tables and JSON documents."""
