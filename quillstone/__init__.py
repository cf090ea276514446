"""quillstone: a Spark-native engine for source trees and document collections."""
