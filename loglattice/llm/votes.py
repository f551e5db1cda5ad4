"""The verification of `keypoints` in Spark's JVM: the same matches, cells and places as its NumPy form, pair by pair and
without arrays in between.

`SOURCE` is compiled by Janino, which Spark brings along for its own generated code, and sent to the executors as a jar.
"""

from __future__ import annotations

import tempfile
import warnings
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SOURCE = r"""
package loglattice;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.ArrayDeque;
import java.util.ArrayList;
import java.util.Arrays;
import java.util.Iterator;

import org.apache.spark.api.java.function.MapPartitionsFunction;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;

/** Features of many images, one image after the other, and votes of pairs of images. */
public final class Features {
    /** Images that one image is compared with at once, and its descriptors of which the closest is looked for first. */
    static final int SOME = 16, ROWS = 4;
    final int match, consensus, turns, levels, wide, circle;
    final double place, spot, shift, factor;
    int images = 0, most = 0;
    int[] starts = new int[1025], voters = new int[1024];
    double[] middleRow = new double[1024], middleColumn = new double[1024];
    final int[][] bits = new int[4][1 << 17];
    char[] row = new char[1 << 17], column = new char[1 << 17];
    short[] angle = new short[1 << 17];
    byte[] level = new byte[1 << 17], voter = new byte[1 << 17];
    final double[] waves, ratios;
    /** By difference of angles; those near the edge of a cell, which rounding decides, aren't taken from here. */
    final short[] turned;
    final int[] steps;
    final int edge;
    int[][] at = new int[0][], own4, differ;
    int[] own, least, of;
    final int[] begins = new int[SOME], found = new int[SOME];
    final int[] count;
    final long[] seen;
    final int cells;
    long[] key = new long[64], voted = new long[256];
    int[] stamp = new int[64], places = new int[64];
    int now = 0;

    Features(double[] numbers) {
        match = (int) numbers[0];
        consensus = (int) numbers[1];
        turns = (int) numbers[2];
        levels = (int) numbers[3];
        wide = (int) numbers[4];
        circle = (int) numbers[5];
        place = numbers[6];
        spot = numbers[7];
        shift = numbers[8];
        factor = numbers[9];
        cells = turns * (levels + 2);
        count = new int[2 * cells];
        seen = new long[8 * cells];
        waves = new double[2 * circle];
        for (int i = 0; i < circle; i++) {
            waves[2 * i] = Math.cos(i * (2 * Math.PI / circle));
            waves[2 * i + 1] = Math.sin(i * (2 * Math.PI / circle));
        }
        edge = circle / java.math.BigInteger.valueOf(circle).gcd(java.math.BigInteger.valueOf(2 * turns)).intValue();
        turned = new short[2 * circle + 1];
        for (int i = -circle; i <= circle; i++) turned[i + circle] = turned(0, i);
        steps = new int[4 * levels];
        for (int i = 0; i < 2 * levels; i++) {
            steps[i] = i / wide;
            steps[2 * levels + i] = cells + (2 * i + wide) / (2 * wide);
        }
        ratios = new double[levels * levels];
        for (int i = 0; i < levels; i++) for (int k = 0; k < levels; k++) ratios[i * levels + k] = Math.pow(factor, k) / Math.pow(factor, i);
    }

    void clear() {
        images = 0;
    }

    void add(byte[] packed, byte[] where) {
        int n = where.length / 8, from = starts[images], end = from + n;
        if (images + 1 >= starts.length) {
            starts = Arrays.copyOf(starts, 2 * images + 3);
            voters = Arrays.copyOf(voters, 2 * images + 2);
            middleRow = Arrays.copyOf(middleRow, 2 * images + 2);
            middleColumn = Arrays.copyOf(middleColumn, 2 * images + 2);
        }
        if (end > row.length) {
            int size = end + end / 2;
            for (int w = 0; w < 4; w++) bits[w] = Arrays.copyOf(bits[w], size);
            row = Arrays.copyOf(row, size);
            column = Arrays.copyOf(column, size);
            angle = Arrays.copyOf(angle, size);
            level = Arrays.copyOf(level, size);
            voter = Arrays.copyOf(voter, size);
        }
        ByteBuffer b = ByteBuffer.wrap(packed).order(ByteOrder.LITTLE_ENDIAN), p = ByteBuffer.wrap(where).order(ByteOrder.LITTLE_ENDIAN);
        long[] spots = new long[n];
        double y = 0, x = 0;
        for (int i = 0; i < n; i++) {
            int k = from + i;
            for (int w = 0; w < 4; w++) bits[w][k] = b.getInt(16 * i + 4 * w);
            row[k] = p.getChar(8 * i);
            column[k] = p.getChar(8 * i + 2);
            angle[k] = p.getShort(8 * i + 4);
            level[k] = (byte) p.getShort(8 * i + 6);
            spots[i] = spot(k);
            y += row[k] / place;
            x += column[k] / place;
        }
        Arrays.sort(spots);
        int kinds = 0;
        for (int i = 0; i < n; i++) if (i == 0 || spots[i] != spots[i - 1]) spots[kinds++] = spots[i];
        for (int k = from; k < end; k++) voter[k] = (byte) Arrays.binarySearch(spots, 0, kinds, spot(k));
        voters[images] = kinds;
        middleRow[images] = y / Math.max(1, n);
        middleColumn[images] = x / Math.max(1, n);
        starts[++images] = end;
        most = Math.max(most, n);
    }

    private long spot(int k) {
        return (long) Math.floor(row[k] / place / spot) << 20 | (long) Math.floor(column[k] / place / spot);
    }

    /** Which of these images agree with image a: hit[i] for right[i]. */
    void agree(int a, int[] right, int rights, boolean[] hit) {
        if (at.length < SOME || at[0].length < most * most + 1) {
            at = new int[SOME][most * most + 1];
            own = new int[2 * most * most + 2];
            own4 = new int[4][SOME * most];
            differ = new int[ROWS][SOME * most];
            least = new int[SOME * most];
            of = new int[SOME * most];
        }
        for (int k = 0; k < rights; k += SOME) {
            int end = Math.min(rights, k + SOME);
            Arrays.fill(hit, k, end, false);
            if (voters[a] < consensus) continue;
            close(a, right, k, end);
            for (int i = k; i < end; i++) hit[i] = found[i - k] >= consensus && agree(a, right[i], at[i - k], found[i - k]);
        }
    }

    /** Of image a and each right one the positions (left << 16 | right) of descriptors of which at most `match` bits differ. The
     loops over all right descriptors are such that the JVM makes vector code of them. */
    private void close(int a, int[] right, int begin, int end) {
        int m = 0, from = starts[a], n = starts[a + 1] - from;
        for (int i = begin; i < end; i++) {
            int to = starts[right[i]], size = starts[right[i] + 1] - to;
            for (int w = 0; w < 4; w++) System.arraycopy(bits[w], to, own4[w], m, size);
            Arrays.fill(of, m, m + size, i - begin);
            begins[i - begin] = m;
            found[i - begin] = 0;
            m += size;
        }
        for (int i = 0; i < n; i += ROWS) {
            int rows = Math.min(ROWS, n - i);
            for (int k = 0; k < ROWS; k++) {
                int x = from + i + Math.min(k, rows - 1);
                differ(own4[0], own4[1], own4[2], own4[3], m, differ[k], bits[0][x], bits[1][x], bits[2][x], bits[3][x]);
            }
            least(differ[0], differ[1], differ[2], differ[3], m, least);
            scan(i, rows, m);
        }
    }

    private void scan(int i, int rows, int m) {
        int[] least = this.least;
        int most = match;
        for (int j = 0; j < m; j++) {
            if (least[j] > most) continue;
            int r = of[j];
            for (int k = 0; k < rows; k++) if (differ[k][j] <= most) at[r][found[r]++] = i + k << 16 | j - begins[r];
        }
    }

    private static void differ(int[] w, int[] x, int[] y, int[] z, int m, int[] out, int a, int b, int c, int d) {
        for (int j = 0; j < m; j++) out[j] = Integer.bitCount(w[j] ^ a) + Integer.bitCount(x[j] ^ b) + Integer.bitCount(y[j] ^ c) + Integer.bitCount(z[j] ^ d);
    }

    private static void least(int[] w, int[] x, int[] y, int[] z, int m, int[] out) {
        for (int j = 0; j < m; j++) out[j] = Math.min(Math.min(w[j], x[j]), Math.min(y[j], z[j]));
    }

    /** Whether enough places of image a vote for one transform to image b: a turn, a scale, and where the middle of a's features
     comes to lie. Each match votes in two neighbouring cells of every measure's shifted grid. */
    private boolean agree(int a, int b, int[] at, int found) {
        int from = starts[a], to = starts[b];
        // a turn and scale with too few places can't have enough of them at one shift
        Arrays.fill(count, 0);
        Arrays.fill(seen, 0);
        for (int k = 0; k < found; k++) {
            int i = from + (at[k] >>> 16), j = to + (at[k] & 0xFFFF), x = angle[i], y = angle[j], step = level[j] - level[i] + levels;
            int t = (y - x) % edge == 0 ? turned(x, y) : turned[y - x + circle];
            int c = (t & 0xFF) + steps[step], d = (t >> 8) + steps[2 * levels + step];
            own[2 * k] = c;
            own[2 * k + 1] = d;
            int word = voter[i] >> 6 & 3;
            long bit = 1L << (voter[i] & 63), old = seen[4 * c + word];
            seen[4 * c + word] = old | bit;
            count[c] += (old & bit) == 0 ? 1 : 0;
            old = seen[4 * d + word];
            seen[4 * d + word] = old | bit;
            count[d] += (old & bit) == 0 ? 1 : 0;
        }
        int live = 0;
        for (int k = 0; k < 2 * found; k++) live += count[own[k]] >= consensus ? 1 : 0;
        if (live == 0) return false;
        if (key.length < 2 * live) {
            int size = Integer.highestOneBit(2 * live) * 2;
            key = new long[size];
            stamp = new int[size];
            places = new int[size];
            voted = new long[4 * size];
            now = 0;
        }
        if (++now == Integer.MAX_VALUE) {
            Arrays.fill(stamp, 0);
            now = 1;
        }
        int mask = key.length - 1;
        for (int k = 0; k < found; k++) {
            boolean first = count[own[2 * k]] >= consensus, second = count[own[2 * k + 1]] >= consensus;
            if (!first && !second) continue;
            int i = from + (at[k] >>> 16), j = to + (at[k] & 0xFFFF), d = (angle[j] - angle[i]) & (circle - 1);
            double scale = ratios[level[i] * levels + level[j]], c = waves[2 * d] * scale, s = waves[2 * d + 1] * scale;
            double oy = row[i] / place - middleRow[a], ox = column[i] / place - middleColumn[a];
            double dy = (row[j] / place - (oy * c + ox * s)) / shift, dx = (column[j] / place - (ox * c - oy * s)) / shift;
            if (first && vote(own[2 * k], (int) Math.floor(dy), (int) Math.floor(dx), voter[i] & 0xFF, mask)) return true;
            if (second && vote(own[2 * k + 1], (int) Math.floor(dy + 0.5), (int) Math.floor(dx + 0.5), voter[i] & 0xFF, mask)) return true;
        }
        return false;
    }

    /** Cells of a turn in both grids, the second one's in the higher byte. */
    private short turned(int x, int y) {
        double unit = 2 * Math.PI / circle, turn = (y * unit - x * unit) / (2 * Math.PI) * turns;
        int t = Math.floorMod((int) Math.floor(turn), turns), u = Math.floorMod((int) Math.floor(turn + 0.5), turns);
        return (short) (u * (levels + 2) << 8 | t * (levels + 2));
    }

    private boolean vote(int cell, int y, int x, int place, int mask) {
        long k = ((long) cell << 11 | (y + 512) & 2047) << 11 | (x + 512) & 2047;
        int s = (int) (k * 0x9E3779B97F4A7C15L >>> 40) & mask;
        while (stamp[s] == now && key[s] != k) s = (s + 1) & mask;
        if (stamp[s] != now) {
            stamp[s] = now;
            key[s] = k;
            places[s] = 0;
            voted[4 * s] = voted[4 * s + 1] = voted[4 * s + 2] = voted[4 * s + 3] = 0;
        }
        int word = 4 * s + (place >>> 6);
        long bit = 1L << (place & 63);
        if ((voted[word] & bit) != 0) return false;
        voted[word] |= bit;
        return ++places[s] >= consensus;
    }

    /** Of each image its place in the order of its bytes as they are stored: bits first, then places. */
    int[] ranks() {
        Integer[] order = new Integer[images];
        for (int i = 0; i < images; i++) order[i] = Integer.valueOf(i);
        Arrays.sort(order, new java.util.Comparator() {
            public int compare(Object x, Object y) {
                return before(((Integer) x).intValue(), ((Integer) y).intValue());
            }
        });
        int[] out = new int[images];
        for (int i = 0; i < images; i++) out[order[i].intValue()] = i;
        return out;
    }

    int before(int a, int b) {
        int x = starts[a], y = starts[b], n = starts[a + 1] - x, m = starts[b + 1] - y, some = Math.min(n, m), c = 0;
        for (int k = 0; k < some; k++)
            for (int w = 0; w < 4; w++) {
                c = Integer.compareUnsigned(Integer.reverseBytes(bits[w][x + k]), Integer.reverseBytes(bits[w][y + k]));
                if (c != 0) return c;
            }
        if (n != m) return n < m ? -1 : 1;
        for (int k = 0; k < n && c == 0; k++) {
            c = Character.reverseBytes(row[x + k]) - Character.reverseBytes(row[y + k]);
            if (c == 0) c = Character.reverseBytes(column[x + k]) - Character.reverseBytes(column[y + k]);
            if (c == 0) c = Character.reverseBytes((char) angle[x + k]) - Character.reverseBytes((char) angle[y + k]);
            if (c == 0) c = (level[x + k] & 0xFF) - (level[y + k] & 0xFF);
        }
        return c;
    }
}

/** Rows of a partition in order of their groups. Pairs: (bi, bj, a, b, bits, places), of each bi, bj first the features of its
 images (a = b), then its pairs; gives linked pairs that join the same images as all linked pairs do. Clusters: (component, bi, bj, side, node, n, bits, places); gives rows of
 links.FOUND. */
public final class Votes implements MapPartitionsFunction, java.io.Serializable {
    public final boolean clusters;
    public final int held;
    public final double[] numbers;

    public Votes(boolean clusters, int held, String numbers) {
        this.clusters = clusters;
        this.held = held;
        String[] each = numbers.split(" ");
        this.numbers = new double[each.length];
        for (int i = 0; i < each.length; i++) this.numbers[i] = Double.parseDouble(each[i]);
    }

    public Iterator call(Iterator rows) {
        return new Judged(this, rows);
    }
}

final class Judged implements Iterator {
    final Votes votes;
    final Iterator rows;
    final Features features;
    final ArrayDeque out = new ArrayDeque();
    Row ahead;
    int bi = -1, bj = -1;
    long[] nodes = new long[1024], ordered, pairs = new long[1024];
    int[] order, rank, root;
    int images = 0, count = 0;

    Judged(Votes votes, Iterator rows) {
        this.votes = votes;
        this.rows = rows;
        features = new Features(votes.numbers);
        ahead = rows.hasNext() ? (Row) rows.next() : null;
    }

    public boolean hasNext() {
        while (out.isEmpty() && ahead != null) {
            if (votes.clusters) cluster();
            else pairs();
        }
        return !out.isEmpty();
    }

    public Object next() {
        if (!hasNext()) throw new java.util.NoSuchElementException();
        return out.poll();
    }

    private void step() {
        ahead = rows.hasNext() ? (Row) rows.next() : null;
    }

    private void image(long node, byte[] b, byte[] p) {
        if (images == nodes.length) nodes = Arrays.copyOf(nodes, 2 * images);
        nodes[images++] = node;
        features.add(b, p);
    }

    /** Some pairs of two blocks: at most as many as may be held, and none of the next two blocks. A pair whose images links have
     joined already joins nothing and is left out. */
    private void pairs() {
        if (bi != ahead.getInt(0) || bj != ahead.getInt(1)) {
            bi = ahead.getInt(0);
            bj = ahead.getInt(1);
            images = 0;
            features.clear();
            while (ahead != null && ahead.getInt(0) == bi && ahead.getInt(1) == bj && !ahead.isNullAt(4)) {
                image(ahead.getLong(2), (byte[]) ahead.get(4), (byte[]) ahead.get(5));
                step();
            }
            rank = features.ranks();
            root = new int[images];
            for (int i = 0; i < images; i++) root[i] = i;
            ordered = Arrays.copyOf(nodes, images);
            Arrays.sort(ordered);
            order = new int[images];
            for (int i = 0; i < images; i++) order[Arrays.binarySearch(ordered, nodes[i])] = i;
        }
        count = 0;
        while (ahead != null && ahead.getInt(0) == bi && ahead.getInt(1) == bj && count <= votes.held) {
            int a = order[Arrays.binarySearch(ordered, ahead.getLong(2))], b = order[Arrays.binarySearch(ordered, ahead.getLong(3))];
            if (count == pairs.length) pairs = Arrays.copyOf(pairs, 2 * count);
            pairs[count++] = rank[a] > rank[b] ? (long) b << 32 | a : (long) a << 32 | b;
            step();
        }
        Arrays.sort(pairs, 0, count);
        int[] right = new int[images];
        boolean[] hit = new boolean[images];
        for (int k = 0, n = 0; k < count; k++) {
            int a = (int) (pairs[k] >>> 32);
            if (top(root, a) != top(root, (int) pairs[k]) && (k == 0 || pairs[k] != pairs[k - 1])) right[n++] = (int) pairs[k];
            if (k + 1 < count && (int) (pairs[k + 1] >>> 32) == a) continue;
            features.agree(a, right, n, hit);
            for (int i = 0; i < n; i++) {
                int b = right[i], x = top(root, a), y = top(root, b);
                if (!hit[i] || x == y) continue;
                root[Math.max(x, y)] = Math.min(x, y);
                out.add(RowFactory.create(new Object[] {Long.valueOf(Math.min(nodes[a], nodes[b])), Long.valueOf(Math.max(nodes[a], nodes[b]))}));
            }
            n = 0;
        }
    }

    /** All pairs of two blocks of a cluster. */
    private void cluster() {
        long component = ahead.getLong(0);
        bi = ahead.getInt(1);
        bj = ahead.getInt(2);
        images = 0;
        features.clear();
        ArrayList sides = new ArrayList(), sizes = new ArrayList();
        while (ahead != null && ahead.getLong(0) == component && ahead.getInt(1) == bi && ahead.getInt(2) == bj) {
            sides.add(Integer.valueOf(ahead.getInt(3)));
            sizes.add(Long.valueOf(ahead.getLong(5)));
            image(ahead.getLong(4), (byte[]) ahead.get(6), (byte[]) ahead.get(7));
            step();
        }
        rank = features.ranks();
        int[] byRank = new int[images];
        root = new int[images];
        long[] links = new long[images];
        for (int i = 0; i < images; i++) {
            byRank[rank[i]] = i;
            root[i] = i;
        }
        int[] right = new int[images];
        boolean[] hit = new boolean[images];
        for (int i = 0; i < images; i++) {
            int a = byRank[i], side = ((Integer) sides.get(a)).intValue(), n = 0;
            for (int k = i + 1; k < images; k++)
                if (side == 2 || side != ((Integer) sides.get(byRank[k])).intValue()) right[n++] = byRank[k];
            features.agree(a, right, n, hit);
            for (int k = 0; k < n; k++) {
                if (!hit[k]) continue;
                int b = right[k], x = top(root, a), y = top(root, b);
                links[a] += ((Long) sizes.get(b)).longValue();
                links[b] += ((Long) sizes.get(a)).longValue();
                root[Math.max(x, y)] = Math.min(x, y);
            }
        }
        for (int i = 0; i < images; i++)
            if (links[i] > 0) out.add(RowFactory.create(new Object[] {Long.valueOf(nodes[i]), Long.valueOf(links[i]), Long.valueOf(nodes[top(root, i)])}));
    }

    private static int top(int[] root, int i) {
        while (root[i] != i) {
            root[i] = root[root[i]];
            i = root[i];
        }
        return i;
    }
}
"""

#: Loader of the compiled classes, by application.
_loaders: dict = {}


def loader(spark: SparkSession):
    """The driver's loader of the classes. The first call of an application compiles them and sends them to its executors."""
    context, jvm = spark.sparkContext, spark._jvm
    if context.applicationId not in _loaders:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        path = f"{tempfile.mkdtemp(prefix='loglattice-')}/votes-{context.applicationId}.jar"
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(path)
        _loaders.clear()
        _loaders[context.applicationId] = compiler.getClassLoader()
    return _loaders[context.applicationId]


def ready(spark: SparkSession) -> bool:
    """Whether the session's JVM has what compiles and runs the classes."""
    try:
        loader(spark)
    except (Py4JError, TypeError, AttributeError, OSError) as missing:
        warnings.warn(f"images are verified by NumPy, which is slower: {missing}", stacklevel=2)
        return False
    return True


def judged(rows: DataFrame, clusters: bool, held: int, numbers: tuple, schema: str) -> DataFrame:
    """What `Votes` gives for each partition of rows."""
    spark = rows.sparkSession
    jvm, given = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 3)
    given[0], given[1], given[2] = clusters, held, " ".join(str(float(x)) for x in numbers)
    function = loader(spark).loadClass("loglattice.Votes").getConstructors()[0].newInstance(given)
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(schema))
    return DataFrame(rows._jdf.mapPartitions(function, encoder), spark)
